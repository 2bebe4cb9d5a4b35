"""Cell-level table preparation on Spark: profile, detect, repair, impute, score."""

from cellsmith.session import build_session, checkpointed, ensure_checkpoint_dir

__all__ = ["build_session", "checkpointed", "ensure_checkpoint_dir"]
