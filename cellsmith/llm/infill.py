"""Fill-in-the-middle documents by one match of a pattern with counted quantifiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsmith.llm.common import bind, col, fresh, text_of

#: Fixed by the query contract: what a text is cut into, and the marks of the three parts.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The same units for a counted quantifier. Possessive: a unit never gives letters back, so n units are the first n of the
#: text, and the matcher loops instead of descending once a unit.
_UNIT = "(?:[A-Za-z]++|[^A-Za-z])"


@dataclass(frozen=True)
class Infill:
    """``seed`` of the draws, and of a hundred texts how many are transformed and how many of those put the suffix first."""

    seed: int = 1
    transformed: int = 90
    suffix_first: int = 20


def _draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(docs: DataFrame, rule: Infill = Infill(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_units``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``, the text to train on.

    ``regexp_count`` gives a text's n units; two draws in 0..n are the ends of prefix and middle, and the pattern
    made for them captures prefix, middle and suffix in one match over the whole text, which writes the output in
    the order of its form: ``psm`` prefix, suffix, middle; ``spm`` suffix, prefix, middle; ``plain`` the text as it is.

    Nothing is shuffled: a draw depends on the id alone. NULL text is empty and plain, as is a text that holds a mark;
    the char counts are NULL there. A NULL id draws as the empty string, rows of one id draw alike, empty parts are
    allowed, an empty table gives an empty result. A result whose name the table has already gets a free one.
    """
    names = [fresh(docs.columns, n) for n in ("n_units", "form", "prefix_chars", "middle_chars", "output")]
    n_units, form, prefix_chars, middle_chars, output = names
    text = text_of(text_col)
    h = _draws(col(id_col), rule.seed)
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (text == "") | marked | (h[2] % 100 >= rule.transformed)
    counted = docs.withColumns(
        {
            n_units: F.regexp_count(text, F.lit(UNIT)).cast("bigint"),
            form: F.when(plain, "plain").when(h[3] % 100 < rule.suffix_first, "spm").otherwise("psm"),
        }
    )
    one, two = (d % (col(n_units) + 1) for d in h[:2])

    def group(units: Column) -> Column:
        return F.concat(F.lit(f"({_UNIT}{{"), units.cast("string"), F.lit("}+)"))

    pattern = F.concat(F.lit(r"(?s)\A"), group(F.least(one, two)), group(F.abs(one - two)), F.lit(r"(.*+)\z"))
    order = F.when(col(form) == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    made = counted.withColumn(output, F.when(col(form) == "plain", text).otherwise(F.regexp_replace(text, pattern, order)))
    # No mark is in the text and none can overlap itself, so a mark's first place is where it was written.
    at = lambda mark: F.instr(col(output), mark)
    shaped = col(form) != "plain"
    mark = len(PREFIX)
    before = F.when(col(form) == "spm", at(MIDDLE) - at(PREFIX)).otherwise(at(SUFFIX) - at(PREFIX)) - mark
    made = made.withColumns(
        {
            prefix_chars: F.when(shaped, before.cast("bigint")),
            middle_chars: F.when(shaped, (F.char_length(col(output)) - at(MIDDLE) - mark + 1).cast("bigint")),
        }
    )
    return made.select(*[col(c) for c in docs.columns], *[col(n) for n in names])


def restore(output: Column, form: Column) -> Column:
    """The text from output and form."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)))
    sewn = bind(parts, lambda p: F.when(form == "spm", F.concat(p[2], p[3], p[1])).otherwise(F.concat(p[1], p[3], p[2])))
    return F.when(form == "plain", output).otherwise(sewn)
