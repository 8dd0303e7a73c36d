"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Token counts are summed to cells (source, language, topic). Raking scales the cells until the source, language and topic
marginals meet their targets; the fit has the form tokens * a(source) * b(language) * c(topic). The table of sources may
be long: each row carries its own small (language, topic) table and gets its a() in place, so one cycle is one aggregate
over that table, and only the sums per (language, topic), at most MAX_CELLS, come back. A document is then kept with a
probability proportional to its cell's factor, up to 1. The scale keeps MIN_KEPT of the documents at least, so that one
small cell with a large factor doesn't set the rate of all others: cells above the scale are kept whole.

Topic is a property of the text's form, decided by fixed rules (see TOPIC), as the corpus names none.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import materialise, table

CYCLES = 12
SEED = "mix-1"
#: Exponents on the present token shares that give the default targets: below 1, rare values gain.
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 0.9}
MAX_CELLS = 20_000
#: Share of the documents with a weight that is kept at least, as expected over the draws.
MIN_KEPT = 0.5
#: A table of source factors is broadcast up to so many rows (about 100 bytes each), else joined by a shuffle.
MAX_BROADCAST_ROWS = 50_000
#: Documents of a source that one part of that join holds, about.
SPLIT_DOCS = 100_000
#: Cycles go on until no marginal misses its target share by more, up to so many cycles.
TOLERANCE, MAX_CYCLES = 1e-6, 60
_DIMS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """Form of a text: "legal" (names a license or copyright), "data" (digits are over 2 % of its characters), "long" (from 6,000 characters), "short" (under 1,000), else "article"."""
    t = F.coalesce(text, F.lit(""))
    size = F.length(t)
    low = F.lower(t)
    digits = size - F.length(F.translate(t, "0123456789", ""))
    return (
        F.when(low.contains("license") | low.contains("copyright"), "legal").when(digits * 50 > size, "data")
        .when(size >= 6000, "long").when(size < 1000, "short").otherwise("article")
    )


def tokens_of(text: Column) -> Column:
    """Tokens of a text as the mixture weighs them: its spaces and line ends plus one; none in a null or empty text."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) == 0, 0).otherwise(F.length(t) - F.length(F.translate(t, " \n", "")) + 1).cast("long")


def _described(docs: DataFrame) -> DataFrame:
    blank = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "lang")}
    return docs.select("*", blank["source"].alias("__source"), blank["lang"].alias("__lang"), topic_of(F.col("text")).alias("__topic"), tokens_of(F.col("text")).alias("__tokens"))


def _targets(values: dict[str, float], exponent: float, wanted: dict[str, float] | None) -> dict[str, float]:
    """Target shares of the values of one dimension that have tokens; they sum to 1."""
    raw = {k: (wanted.get(k, 0.0) if wanted is not None else v**exponent) for k, v in values.items() if v > 0}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()} if total else {}


def _scale(cells: DataFrame, top: float, share: float) -> float:
    """The least c >= 1 / top, to a few digits, so that min(1, weight * c) keeps share of the documents of cells (docs, weight)."""
    n, low = cells.where("weight > 0").agg(F.sum("docs"), F.min("weight")).first()
    at, end = 1.0 / top, max(1.0 / top, 1.0 / low) if n else 0.0
    if not n or at == end:
        return at
    for _ in range(3):
        grid = [*(at * (end / at) ** (k / 32) for k in range(32)), end]
        kept = cells.agg(*(F.sum(F.col("docs") * F.least(F.lit(1.0), F.col("weight") * F.lit(c))) for c in grid)).first()
        k = next((k for k, x in enumerate(kept) if x >= share * n), len(grid) - 1)
        if not k:
            return grid[0]
        at, end = grid[k - 1], grid[k]
    return end


def rake(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, cycles: int = CYCLES, min_kept: float = MIN_KEPT) -> DataFrame:
    """docs with topic, tokens, weight and keep_prob.

    weight is fitted over present tokens of the document's cell, 1 on average over the corpus; keep_prob is min(1, weight *
    c). c is one over the largest weight, or what it takes to keep min_kept of the documents whose weight isn't 0. targets gives shares by "lang" and "topic" ({value: share}; values that it leaves out get none), and by
    "source" too; without them, shares follow TEMPER. A null source or lang is the value "". Texts without tokens have
    weight 0 in the sums and share their cell's factor; a cell without any token has weight 1. Columns of docs named topic,
    tokens, weight or keep_prob are replaced. Repeated rows weigh each; very long texts count whole. An empty table gives no
    rows. After cycles cycles the fit goes on until every marginal is within TOLERANCE of its target; a warning says so if
    MAX_CYCLES don't reach that.
    """
    targets = targets or {}
    cols = [c for c in docs.columns if c not in ("topic", "tokens", "weight", "keep_prob") and not c.startswith("__")]
    rows = _described(docs.select(*cols))
    cells = rows.groupBy("__source", "__lang", "__topic").agg(F.sum("__tokens").cast("double").alias("n"), F.count("*").alias("docs"))
    by_source = cells.groupBy("__source").agg(F.sort_array(F.collect_list(F.struct("__lang", "__topic", "n", "docs"))).alias("cells"), F.sum("n").alias("n"))
    by_source = materialise(by_source, "cells")
    n_sources, total = by_source.agg(F.count("*"), F.sum("n")).first()
    if not n_sources or not total:
        return rows.select(*cols, F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("keep_prob"))
    exploded = by_source.select("__source", F.explode("cells").alias("c")).select("__source", "c.*")
    pairs = exploded.groupBy("__lang", "__topic").agg(F.sum("n").alias("n")).where("n > 0").orderBy("__lang", "__topic").limit(MAX_CELLS + 1).collect()
    if len(pairs) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} pairs of language and topic")
    langs, topics = sorted({p[0] for p in pairs}), sorted({p[1] for p in pairs})
    present = lambda i, v: sum(p[2] for p in pairs if p[i] == v)
    t_lang = _targets({v: present(0, v) for v in langs}, TEMPER["lang"], targets.get("lang"))
    t_topic = _targets({v: present(1, v) for v in topics}, TEMPER["topic"], targets.get("topic"))
    if "source" in targets:
        want = F.create_map(*[x for k, v in targets["source"].items() for x in (F.lit(k), F.lit(float(v)))])
        raw = F.when(F.col("n") > 0, F.coalesce(want[F.col("__source")], F.lit(0.0))).otherwise(0.0)
    else:
        raw = F.pow("n", F.lit(TEMPER["source"]))
    all_raw = by_source.agg(F.sum(raw)).first()[0] or 1.0
    by_source = by_source.withColumn("target", raw / F.lit(all_raw))
    b, c = dict.fromkeys(langs, 1.0), dict.fromkeys(topics, 1.0)

    def scaled() -> DataFrame:
        """Each source with its factor a under the present b and c."""
        mb = F.create_map(*[x for k, v in b.items() for x in (F.lit(k), F.lit(v))])
        mc = F.create_map(*[x for k, v in c.items() for x in (F.lit(k), F.lit(v))])
        factor = lambda x: F.coalesce(mb[x["__lang"]], F.lit(0.0)) * F.coalesce(mc[x["__topic"]], F.lit(0.0))
        mass = F.aggregate("cells", F.lit(0.0), lambda acc, x: acc + x["n"] * factor(x))
        return by_source.withColumn("a", F.when(mass > 0, F.col("target") / mass).otherwise(0.0))

    for cycle in range(max(cycles + 1, MAX_CYCLES)):
        mine = scaled().select("a", F.explode("cells").alias("x")).groupBy("x.__lang", "x.__topic").agg(F.sum(F.col("a") * F.col("x.n")).alias("m"))
        m = {(r[0], r[1]): r[2] for r in mine.collect() if (r[0] in b and r[1] in c)}  # at most MAX_CELLS sums
        if cycle >= cycles:
            # sources meet their targets here; the others are left by the last cycle as they are
            miss = [abs(sum(m.get((v, t), 0.0) * b[v] * c[t] for t in topics) - t_lang.get(v, 0.0)) for v in langs]
            miss += [abs(sum(m.get((v, t), 0.0) * b[v] * c[t] for v in langs) - t_topic.get(t, 0.0)) for t in topics]
            if max(miss) <= TOLERANCE:
                break
        for lang in langs:
            now = sum(m.get((lang, t), 0.0) * c[t] for t in topics)
            b[lang] = t_lang.get(lang, 0.0) / now if now > 0 else 0.0
        for topic in topics:
            now = sum(m.get((v, topic), 0.0) * b[v] for v in langs)
            c[topic] = t_topic.get(topic, 0.0) / now if now > 0 else 0.0
    else:
        # targets that contradict each other (a share for a cell set without tokens) can't all be met
        warnings.warn(f"raking leaves a marginal off by {max(miss):.2g} after {MAX_CYCLES} cycles", stacklevel=2)
    fitted = scaled().select("__source", "a", F.explode("cells").alias("x")).select("__source", "a", "x.*")
    mb = F.create_map(*[x for k, v in b.items() for x in (F.lit(k), F.lit(v))])
    mc = F.create_map(*[x for k, v in c.items() for x in (F.lit(k), F.lit(v))])
    # shares were fitted to 1 in all, so a cell's factor times the corpus's tokens is its weight
    weight = F.col("a") * F.coalesce(mb[F.col("__lang")], F.lit(0.0)) * F.coalesce(mc[F.col("__topic")], F.lit(0.0)) * F.lit(float(total))
    top = fitted.where("n > 0").agg(F.max(weight)).first()[0] or 1.0
    factors = fitted.groupBy("__source").agg(F.first("a").alias("__a"))
    if n_sources <= MAX_BROADCAST_ROWS:
        joined = rows.join(F.broadcast(factors.withColumnRenamed("__source", "__s")), F.col("__source") == F.col("__s"), "left")
    else:
        # a source with more than SPLIT_DOCS documents is joined in parts; such sources are few enough for a broadcast
        parts = exploded.groupBy("__source").agg(F.ceil(F.sum("docs") / F.lit(SPLIT_DOCS)).cast("int").alias("__parts"))
        large = F.broadcast(parts.where("__parts > 1").withColumnRenamed("__source", "__large"))
        each = factors.join(parts, "__source").select(F.col("__source").alias("__s"), "__a", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"))
        mine = F.pmod(F.xxhash64(*(c for c in ("doc_id", "text") if c in cols)), F.coalesce("__parts", F.lit(1))).cast("int")
        split = rows.join(large, F.col("__source") == F.col("__large"), "left").withColumn("__mine", mine)
        joined = split.join(each, (F.col("__source") == F.col("__s")) & (F.col("__mine") == F.col("__part")), "left")
    seen = [(p[0], p[1]) for p in pairs]
    # only texts without tokens can lie in a cell that has none
    listed = F.array_contains(F.array(*[F.lit(f"{x}\x00{y}") for x, y in seen]), F.concat("__lang", F.lit("\x00"), "__topic"))
    joined = joined.withColumnRenamed("__a", "a")
    w = F.when((F.col("__tokens") > 0) | listed, weight).otherwise(1.0)
    out = joined.withColumn("weight", w).select(*cols, F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"), "weight")
    c = _scale(fitted.select("docs", F.when((F.col("n") > 0) | listed, weight).otherwise(1.0).alias("weight")), top, min_kept) if min_kept else 0.0
    prob = F.col("weight") * F.lit(c) if c > 1.0 / top else F.col("weight") / F.lit(top)
    return out.withColumn("keep_prob", F.least(F.lit(1.0), prob))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """Uniform in [0, 1) and fixed by doc_id and seed; a null id counts as the empty text."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, seed: str = SEED) -> DataFrame:
    """The documents that the mixture keeps, with their own columns."""
    raked = rake(docs.select("doc_id", "text", "source", "lang", F.struct(*docs.columns).alias("record")), targets)
    return raked.where(draw(F.col("doc_id"), seed) < F.col("keep_prob")).select("record.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated weight, probability and decision for every document; the SQL of the query takes the largest weight for the scale."""
    raked = rake(table(spark, sf_dir, "documents"), min_kept=0.0)
    return raked.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "topic", "tokens",
        F.round("weight", 6).alias("weight"), F.round("keep_prob", 6).alias("keep_prob"), (draw(F.col("doc_id")) < F.col("keep_prob")).alias("kept"),
    )


def _oracle() -> str:
    """The same fit in SQL: CYCLES rounds of source, language and topic scaling over the cells."""
    step = []
    prev = "w0"
    for k in range(CYCLES):
        for d in _DIMS:
            name = f"w{k}_{d}"
            step.append(f"{name} AS (SELECT source, lang, topic, n, CASE WHEN s > 0 THEN f * target / s ELSE 0 END AS f FROM (SELECT p.*, sum(n * f) OVER (PARTITION BY p.{d}) AS s, t.target FROM {prev} p JOIN t_{d} t ON t.v = p.{d}))")
            prev = name
    # the last factor of the sources is taken after the last language and topic scaling
    step.append(f"fit AS (SELECT source, lang, topic, n, CASE WHEN s > 0 THEN f * target / s ELSE 0 END * (SELECT sum(n) FROM cells) AS weight FROM (SELECT p.*, sum(n * f) OVER (PARTITION BY p.source) AS s, t.target FROM {prev} p JOIN t_source t ON t.v = p.source))")
    marginals = ",\n".join(f"t_{d} AS (SELECT {d} AS v, pow(sum(n), {TEMPER[d]}) / sum(pow(sum(n), {TEMPER[d]})) OVER () AS target FROM cells GROUP BY {d})" for d in _DIMS)
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
e AS MATERIALIZED (
  SELECT doc_id, source, lang,
    CASE WHEN contains(lower(t), 'license') OR contains(lower(t), 'copyright') THEN 'legal'
         WHEN (length(t) - length(translate(t, '0123456789', ''))) * 50 > length(t) THEN 'data'
         WHEN length(t) >= 6000 THEN 'long' WHEN length(t) < 1000 THEN 'short' ELSE 'article' END AS topic,
    CASE WHEN length(t) = 0 THEN 0 ELSE length(t) - length(translate(t, ' ' || chr(10), '')) + 1 END::BIGINT AS tokens
  FROM d),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS n FROM e GROUP BY ALL),
{marginals},
w0 AS (SELECT source, lang, topic, n, 1.0::DOUBLE AS f FROM cells WHERE n > 0),
{", ".join(step)}
SELECT e.doc_id, e.source, e.lang, e.topic, e.tokens, round(coalesce(fit.weight, 1.0), 6) AS weight,
  round(least(1.0, coalesce(fit.weight, 1.0) / (SELECT max(weight) FROM fit)), 6) AS keep_prob,
  ('0x' || substr(md5('{SEED}:' || coalesce(e.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)} < least(1.0, coalesce(fit.weight, 1.0) / (SELECT max(weight) FROM fit)) AS kept
FROM e LEFT JOIN fit ON e.source = fit.source AND e.lang = fit.lang AND e.topic = fit.topic
"""


ORACLE = _oracle()
