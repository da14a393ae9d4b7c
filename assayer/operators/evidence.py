"""Independence of evidence: sources that share a group or a dataset are one piece, also through third sources.

Edges are rows (claim, src, grp, data, stance): a source with several groups or datasets has several rows, and a null
group or dataset is an unknown one, which joins nothing. Claims, sources, groups and datasets are strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import let
from assayer.operators.graphs import components
from assayer.operators.skew import look_up
from assayer.sources.written import Rounds

SUPPORT, CONTRADICT = "support", "contradict"
#: One side of a claim with so many rows at most is folded where it lies: the fold's work grows with the square. Larger ones go by rounds.
FOLDED = 256


def _text_edges(edges: DataFrame) -> DataFrame:
    return edges.select("claim", "stance", F.col("src").cast("string").alias("src"), F.col("grp").cast("string").alias("grp"), F.col("data").cast("string").alias("data")).where("claim IS NOT NULL AND stance IS NOT NULL AND src IS NOT NULL")


def _split(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges of claims' sides of ``FOLDED`` rows at most, and those of larger sides, or None if there are none. Only the large sides'
    keys are written, which are few: a row for ``FOLDED`` edges at most."""
    key = ["claim", "stance"]
    large = Rounds(edges.sparkSession).keep(edges.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > FOLDED))
    if large.isEmpty():
        return edges, None
    marked = look_up(edges, large.withColumn("large", F.lit(True)), key, "left", counts="n")
    return marked.where("large IS NULL").drop("large"), marked.where("large").drop("large")


def _folded(edges: DataFrame) -> DataFrame:
    """Pieces of sides of few rows: one row a side, whose edges are folded into sets of sources, groups and data. An edge unites the sets that it touches."""
    has = lambda names, name: F.coalesce(F.array_contains(names, name), F.lit(False))

    def add(sets: Column, edge: Column) -> Column:
        def united(found: Column) -> Column:
            touched = F.filter(found, lambda p: p["hit"])
            union = lambda c: F.array_distinct(F.concat(F.flatten(F.transform(touched, lambda p: p["set"][c])), F.when(edge[c].isNotNull(), F.array(edge[c])).otherwise(F.array().cast("array<string>")))).alias(c)
            return F.concat(F.transform(F.filter(found, lambda p: ~p["hit"]), lambda p: p["set"]), F.array(F.struct(*map(union, ("src", "grp", "data")))))

        hit = lambda p: has(p["src"], edge["src"]) | has(p["grp"], edge["grp"]) | has(p["data"], edge["data"])
        return let(F.transform(sets, lambda p: F.struct(p.alias("set"), hit(p).alias("hit"))), united)

    none = F.array().cast("array<struct<src:array<string>,grp:array<string>,data:array<string>>>")
    sides = edges.groupBy("claim", "stance").agg(F.collect_list(F.struct("src", "grp", "data")).alias("edges"))
    sets = sides.select("claim", "stance", F.explode(F.aggregate("edges", none, add)).alias("set"))
    return sets.select("claim", "stance", F.col("set.src").alias("sources"), F.array_min("set.src").alias("piece"))


def pieces(edges: DataFrame) -> DataFrame:
    """(claim, stance, src, piece): ``piece`` is the first source, by name, of those that share a group or a dataset
    with this one in the same claim and stance, directly or through others.

    Sides of few rows are folded; components of all the larger ones are sought at once, so that no task holds one of these.
    """
    small, large = _split(_text_edges(edges))
    found = _folded(small).select("claim", "stance", F.explode("sources").alias("src"), "piece")
    return found if large is None else found.unionByName(_linked(large))


def _linked(edges: DataFrame) -> DataFrame:
    """Pieces of sides of any size."""
    # kinds sort sources first, so the smallest vertex of a component is its first source
    vertex = lambda kind, name: F.struct("claim", "stance", F.lit(kind).alias("kind"), F.col(name).alias("name"))
    shared = F.explode(F.array(F.when(F.col("grp").isNotNull(), vertex(1, "grp")), F.when(F.col("data").isNotNull(), vertex(2, "data"))))
    links = edges.select(vertex(0, "src").alias("x"), shared.alias("y"))
    found = components(links).where("v.kind = 0").select(F.col("v.claim").alias("claim"), F.col("v.stance").alias("stance"), F.col("v.name").alias("src"), F.col("c.name").alias("_c"))
    return edges.select("claim", "stance", "src").distinct().join(found, ["claim", "stance", "src"], "left").select("claim", "stance", "src", F.coalesce("_c", "src").alias("piece"))


def bucket(support: Column, contradict: Column) -> Column:
    """settled: two pieces or more support and none contradicts; contested: both; refuted: only contradiction; open: the rest."""
    return F.when((support > 0) & (contradict > 0), "contested").when(contradict > 0, "refuted").when(support > 1, "settled").otherwise("open")


def independent_claims(edges: DataFrame) -> DataFrame:
    """Claims with their sources and independent pieces on either side, the largest piece's sources, and the bucket."""
    small, large = _split(_text_edges(edges))
    sizes = _folded(small).select("claim", "stance", "piece", F.size("sources").cast("long").alias("n"))  # a source is in one set of a side
    if large is not None:
        sizes = sizes.unionByName(_linked(large).groupBy("claim", "stance", "piece").agg(F.count("*").alias("n")))
    side = lambda what: F.col("stance") == what
    rows = sizes.groupBy("claim").agg(
        F.sum("n").alias("n_sources"),
        F.count_if(side(SUPPORT)).alias("n_support"),
        F.count_if(side(CONTRADICT)).alias("n_contradict"),
        F.max("n").alias("largest_piece"),
    )
    return rows.withColumn("bucket", bucket(F.col("n_support"), F.col("n_contradict")))
