"""Row-wise steps on unbounded tables."""
