"""Pre-registered specifications: the hashed payload, its digest, and whether it was altered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import parsing
from assayer.functions.text import let, squeeze, unquote

#: Hashed keys in their order, and the length of a digest (fixed values of the format).
HASHED_KEYS = ("id", "hypothesis", "arms", "baseline", "dataset", "metrics", "controls", "seeds", "scale")
HASH_LENGTH = 16


def payload(raw: Column, body: Column) -> Column:
    """The text that the digest covers: the keys' values and the rule, white space collapsed. A rule section of the body goes before the front matter's."""
    def text(m: Column) -> Column:
        value = lambda k: squeeze(F.coalesce(F.try_element_at(m, F.lit(k)), F.lit("")))
        rule = let(F.locate(parsing.RULE_HEADING, body), lambda at: F.when(at > 0, squeeze(section(at))).otherwise(value("decision_rule")))
        return F.concat_ws("\n", *(F.concat(F.lit(f"{k}="), value(k)) for k in HASHED_KEYS), F.concat(F.lit("decision_rule="), rule))

    def section(at: Column) -> Column:
        tail = F.substring(body, at, F.length(body))
        return let(F.locate("\n## ", tail, 2), lambda end: F.when(end > 0, F.substring(tail, F.lit(1), end - 1)).otherwise(tail))

    return let(parsing.blocks(raw), text)


def digest(raw: Column, body: Column) -> Column:
    return F.substring(F.sha2(payload(raw, body), 256), 1, HASH_LENGTH)


def recorded(fm: Column) -> Column:
    """The registered digest of a note's fields; empty if there is none."""
    return unquote(F.coalesce(F.try_element_at(fm, F.lit("spec_hash")), F.lit("")))


def with_digest(text: Column) -> Column:
    """The text of a spec with its digest in ``spec_hash:``, put after ``id:`` if the line is absent."""

    def new(p: Column) -> Column:
        raw, body = p["raw"], p["body"]
        line = F.concat(F.lit("spec_hash: "), digest(raw, body))
        lines = F.split(raw, "\n")
        old = F.transform(lines, lambda x: x.startswith("spec_hash:"))
        has = F.array_position(old, True)
        after = let(F.array_position(F.transform(lines, lambda x: x.startswith("id:")), True), lambda at: F.when(at > 0, at).otherwise(F.size(lines)))
        # the first spec_hash line goes, or none; the new one stands in its place, or after id
        gone = F.when(has > 0, F.lit(1)).otherwise(0)
        return let(
            F.when(has > 0, has - 1).otherwise(after).cast("int"),
            lambda at: F.concat(F.lit("---"), F.array_join(F.concat(F.slice(lines, F.lit(1), at), F.array(line), F.slice(lines, at + 1 + gone, F.size(lines))), "\n"), F.lit("\n---"), body),
        )

    return let(F.struct(parsing.front_matter(text).alias("raw"), parsing.body(text).alias("body")), new)


def rule_drift(raw: Column, body: Column) -> Column:
    """Whether the rules of front matter and body differ. A verdict follows the one, the digest covers the other."""
    front = squeeze(F.coalesce(F.try_element_at(parsing.blocks(raw), F.lit("decision_rule")), F.lit("")))
    fenced = squeeze(F.regexp_extract(body, r"(?s)```ya?ml\n(.*?metric:.*?)```", 1))
    bare = F.regexp_replace(fenced, r"^decision_rule: ?", "")
    return (front != "") & (fenced != "") & (front != bare)


def registrations(notes: DataFrame) -> DataFrame:
    """Specs with the recorded digest, the recomputed one, and whether the rules of front matter and body differ."""
    return notes.where("type = 'spec'").select(
        "vault",
        "rel",
        recorded(F.col("fm")).alias("recorded"),
        digest(F.col("fm_raw"), F.col("body")).alias("digest"),
        rule_drift(F.col("fm_raw"), F.col("body")).alias("rule_drift"),
    )
