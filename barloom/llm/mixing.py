"""Operator 3, mixing sources to target weights: iterative proportional fitting.

Documents fall into cells (source, language, topic).  The cells' sampling
probabilities start at the budget and are raked: for one margin after the
other they are scaled so that the expected tokens of each category meet its
target, never above 1.  Documents are then kept by comparing a hash of their
id with the probability of their cell.  DataFrame functions only.

Defined results: a null category is a category of its own, written ``(null)``;
a null text has no tokens.  Cells without tokens keep the probability they
have.  Named shares are scaled to the categories that occur; categories
without a named share divide what is left over in proportion to their tokens.
The probability depends on the cell and the decision on the id, so repeated
rows are decided alike.  Very long texts are counted whole.  ``sample`` keeps
all columns, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, spare_name, text_or_empty

WORD = r"[^ \t\n\x0B\f\r]+"
#: Topics by the first pattern that occurs in a text.  Fixed values of this library.
TOPICS = (("contact", r"[A-Za-z0-9]@[A-Za-z0-9]|<EMAIL>"), ("licence", r"[Ll]icen[sc]e|[Cc]opyright"), ("tabular", r" \| "))
OTHER_TOPIC = "prose"
#: Up to this many cells are raked in one partition, without any shuffle; more are raked by distributed aggregates and joins.
ONE_PARTITION_CELLS = 20_000


@dataclass(frozen=True)
class Target:
    """Wanted token shares of one margin: named shares, or natural shares to a power (1: as they are, 0: equal)."""

    shares: Mapping[str, float] = field(default_factory=dict)
    temper: float = 1.0


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def topic_of(text: Column, topics: tuple[tuple[str, str], ...] = TOPICS) -> Column:
    out = F.lit(OTHER_TOPIC)
    for name, pattern in reversed(topics):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("(null)"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _with_target(cells: DataFrame, dim: str, target: Target, total: float, budget: float, small: bool) -> DataFrame:
    """Adds the tokens wanted for the cell's category of one margin."""
    margin = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("have"))
    if target.shares:
        named = F.create_map(*[F.lit(x) for kv in target.shares.items() for x in kv])
        share = F.try_element_at(named, F.col(dim))
        left = max(0.0, 1.0 - sum(target.shares.values()))
        unnamed = margin.where(share.isNull()).agg(F.coalesce(F.sum("have"), F.lit(0.0))).first()[0]
        raw = F.coalesce(share.cast("double"), F.col("have") * F.lit(left / unnamed if unnamed else 0.0))
    else:
        raw = F.when(F.col("have") > 0, F.pow(F.col("have") / F.lit(total), F.lit(float(target.temper)))).otherwise(F.lit(0.0))
    margin = margin.select(dim, raw.alias("raw"))
    whole = margin.agg(F.coalesce(F.sum("raw"), F.lit(0.0))).first()[0] or 1.0
    margin = margin.select(dim, (F.col("raw") / F.lit(whole) * F.lit(total * budget)).alias(f"want_{dim}"))
    return cells.join(F.broadcast(margin) if small else margin, dim)


def rake(cells: DataFrame, targets: Mapping[str, Target], budget: float, iterations: int) -> DataFrame:
    """Cells (dims..., tokens) with the calibrated probability ``p``.

    Every round meets the margins one after the other.  A bounded number of
    cells stays in one partition, where windows need no shuffle.
    """
    total = float(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]) or 1.0
    small = cells.count() <= ONE_PARTITION_CELLS
    if small:
        cells = cells.coalesce(1)
    for dim, target in targets.items():
        cells = _with_target(cells, dim, target, total, budget, small)
    cells = cells.withColumn("p", F.lit(float(budget)))
    for _ in range(iterations):
        for dim in targets:
            now = F.col("tokens") * F.col("p")
            if small:
                got = F.sum(now).over(Window.partitionBy(dim))
                cells = cells.withColumn("got", got)
            else:
                cells = cells.join(cells.groupBy(dim).agg(F.sum(now).alias("got")), dim)
            factor = F.when(F.col("got") > 0, F.col(f"want_{dim}") / F.col("got")).otherwise(F.lit(1.0))
            cells = cells.withColumn("p", F.least(F.lit(1.0), F.col("p") * factor)).drop("got")
        if not small:
            cells = materialise(cells, "raking")
    return cells


def mix(docs: DataFrame, targets: Mapping[str, Target], budget: float = 0.5, iterations: int = 10) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, tokens, probability, sampled."""
    text = text_or_empty()
    tagged = docs.select(
        "doc_id", *[F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias(c) for c in ("source", "lang")], topic_of(text).alias("topic"), tokens(text).alias("tokens")
    )
    tagged = materialise(tagged, "mixing")
    dims = list(targets)
    cells = materialise(tagged.groupBy(*dims).agg(F.sum("tokens").alias("tokens")), "cells")
    fitted = materialise(rake(cells, targets, budget, iterations).select(*dims, "p"), "fitted")
    if fitted.count() <= ONE_PARTITION_CELLS:
        fitted = F.broadcast(fitted)
    joined = tagged.join(fitted, dims)
    return joined.select("doc_id", "source", "lang", "topic", "tokens", F.round("p", 9).alias("probability"), (uniform(F.col("doc_id")) < F.col("p")).alias("sampled"))


def margins(fitted: DataFrame, targets: Mapping[str, Target]) -> DataFrame:
    """(dim, category, wanted, expected) of raked cells: tokens wanted, and expected of the probabilities.

    They differ where rounds were too few, or where even all of a category's
    tokens (probability 1) are fewer than wanted.
    """
    parts = [fitted.groupBy(F.lit(d).alias("dim"), F.col(d).alias("category")).agg(F.max(f"want_{d}").alias("wanted"), F.sum(F.col("tokens") * F.col("p")).alias("expected")) for d in targets]
    return reduce(DataFrame.unionByName, parts)


def sample(docs: DataFrame, targets: Mapping[str, Target], budget: float = 0.5, iterations: int = 10) -> DataFrame:
    """The rows of ``docs`` that the calibrated probabilities keep, with their own columns.

    Topics and tokens are read from the texts once and stored with the rows.
    """
    text = text_or_empty()
    names = {dim: spare_name(docs, dim) for dim in targets}
    size, p = spare_name(docs, "tokens"), spare_name(docs, "p")
    made = {"source": F.coalesce(F.col("source").cast("string"), F.lit("(null)")), "lang": F.coalesce(F.col("lang").cast("string"), F.lit("(null)")), "topic": topic_of(text)}
    tagged = materialise(docs.withColumns({names[dim]: made[dim] for dim in targets} | {size: tokens(text)}), "mixing")
    cells = tagged.groupBy(*[F.col(names[dim]).alias(dim) for dim in targets]).agg(F.sum(size).alias("tokens"))
    fitted = materialise(rake(materialise(cells, "cells"), targets, budget, iterations).select(*[F.col(d).alias(names[d]) for d in targets], F.col("p").alias(p)), "fitted")
    if fitted.count() <= ONE_PARTITION_CELLS:
        fitted = F.broadcast(fitted)
    joined = tagged.join(fitted, list(names.values()))
    return joined.where(uniform(F.col("doc_id")) < F.col(p)).select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(documents: str, targets: Mapping[str, Target], budget: float, iterations: int) -> str:
    """The same rows as ``mix`` in DuckDB SQL."""
    topic = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in TOPICS) + f" ELSE '{OTHER_TOPIC}' END"
    dims = list(targets)
    ctes = [
        f"""tagged AS (SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang, {topic} AS topic,
        CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS tokens FROM {documents})""",
        f"c0 AS (SELECT {', '.join(dims)}, sum(tokens)::DOUBLE AS tokens FROM tagged GROUP BY ALL)",
        "total AS (SELECT sum(tokens) AS n FROM c0)",
    ]
    for dim, target in targets.items():
        if target.shares:
            values = ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in target.shares.items())
            left = max(0.0, 1.0 - sum(target.shares.values()))
            raw = f"coalesce(s.share, m.have * {left!r}::DOUBLE / nullif(sum(CASE WHEN s.share IS NULL THEN m.have END) OVER (), 0), 0)"
            source = f"m LEFT JOIN (VALUES {values}) AS s(cat, share) ON m.{dim} = s.cat"
        else:
            raw = f"CASE WHEN m.have > 0 THEN pow(m.have / (SELECT n FROM total), {target.temper!r}::DOUBLE) ELSE 0 END"
            source = "m"
        ctes.append(
            f"""want_{dim} AS (WITH m AS (SELECT {dim}, sum(tokens) AS have FROM c0 GROUP BY {dim}), r AS (SELECT m.{dim}, {raw} AS raw FROM {source})
            SELECT {dim}, raw / sum(raw) OVER () * (SELECT n FROM total) * {budget!r}::DOUBLE AS want FROM r)"""
        )
    joins = " ".join(f"JOIN want_{d} USING ({d})" for d in dims)
    ctes.append(f"p0 AS (SELECT c0.*, {', '.join(f'want_{d}.want AS w_{d}' for d in dims)}, {budget!r}::DOUBLE AS p FROM c0 {joins})")
    last = 0
    for _ in range(iterations):
        for d in dims:
            got = f"sum(tokens * p) OVER (PARTITION BY {d})"
            ctes.append(f"p{last + 1} AS MATERIALIZED (SELECT * EXCLUDE (p), least(1.0::DOUBLE, p * CASE WHEN {got} > 0 THEN w_{d} / {got} ELSE 1 END) AS p FROM p{last})")
            last += 1
    u = "CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '(null)')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"
    return f"WITH {', '.join(ctes)} SELECT doc_id, source, lang, topic, t.tokens, round(p, 9) AS probability, {u} < p AS sampled FROM tagged t JOIN p{last} c USING ({', '.join(dims)})"
