"""Mixing sources to target weights: iterative proportional fitting over source, language and topic.

Everything is DataFrame operations.  Documents are summed to cells (source, language, topic) with a map-side partial sum,
so that a hot source is a few cells.  Each sweep scales the cells' token weights to one margin after the other
with window sums, then trims each weight to what the cell can give.  A document is kept with the probability its cell's
weight asks for, by a hash of its id: the choice needs no state and is the same in every run.

The cells' number is checked.  Up to `small` of them the sweeps run in one partition without a shuffle and the
probabilities are broadcast; beyond, the same windows and the join shuffle by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import col, spread
from .graph import stored
from .shared import new_folder

MARGINS = ("m1", "m2", "m3")
SYMBOLS = "#*$%&|<>"
SWEEPS = 10


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def style_topic(text: Column, tokens: Column) -> Column:
    """A topic by style: symbols (over one in five tokens), lists (a line has under 12 tokens), or prose."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    breaks = F.length(text) - F.length(F.translate(text, "\n", ""))
    return F.when(5 * symbols > tokens, "symbols").when(12 * (breaks + 1) > tokens, "lists").otherwise("prose")


def tempered(cells: DataFrame, margin: str, power: float) -> Column:
    """A margin's target share: its share of the tokens to `power`, made to sum to one; one row a value carries it."""
    by = Window.partitionBy(margin).orderBy(*MARGINS)
    return F.when(F.row_number().over(by) == 1, F.pow(F.sum("tokens").over(Window.partitionBy(margin)), F.lit(power))).otherwise(F.lit(0.0))


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None, power: float, rate: float, sweeps: int, folder: str) -> DataFrame:
    """cells (m1, m2, m3, tokens) with weight: raked to the targets, each weight at most tokens / rate.

    targets: for a margin, a table (value, share); a margin without one is tempered.  Values that the table lacks get
    share 0.  Weights sum to the tokens, apart from what trimming takes.
    """
    everything = Window.partitionBy()
    for m in MARGINS:
        if targets and m in targets:
            share = targets[m].select(F.coalesce(F.col("value"), F.lit("")).alias(m), F.col("share").cast("double").alias(f"{m}_to"))
            cells = cells.join(share, m, "left").withColumn(f"{m}_to", F.coalesce(f"{m}_to", F.lit(0.0)))
        else:
            cells = cells.withColumn("once", tempered(cells, m, power))
            cells = cells.withColumn(f"{m}_to", F.max("once").over(Window.partitionBy(m)) / F.sum("once").over(everything)).drop("once")
    cells = cells.withColumn("all", F.sum("tokens").over(everything).cast("double")).withColumn("weight", F.col("tokens").cast("double"))
    for k in range(sweeps):
        for m in MARGINS:
            total = F.sum("weight").over(Window.partitionBy(m))
            cells = cells.withColumn("weight", F.when(total > 0, F.col("weight") * (F.col(f"{m}_to") * F.col("all") / total)).otherwise(F.lit(0.0)))
        cells = cells.withColumn("weight", F.least("weight", F.col("tokens") / F.lit(rate)))
        if k % 5 == 4:
            cells = stored(cells, folder, f"sweep-{k}")
    return cells


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the md5 of key and seed."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def measure(docs: DataFrame, text_col: str = "text", topic: Column | None = None) -> DataFrame:
    """docs with n_tokens and topic (topic: an expression; by default the text's style)."""
    marks = docs.drop("n_tokens", "topic").withColumn("n_tokens", token_count(col(text_col)))
    return marks.withColumn("topic", F.coalesce(topic if topic is not None else style_topic(F.coalesce(col(text_col), F.lit("")), F.col("n_tokens")), F.lit("")))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None,
    targets: dict[str, DataFrame] | None = None, power: float = 0.7, rate: float = 0.5, sweeps: int = SWEEPS, seed: str = "mix", small: int = 100_000, measured: bool = False,
) -> DataFrame:
    """docs with n_tokens, topic, probability and sampled.

    Token weights are raked to the targets of m1 (source), m2 (language) and m3 (topic); without targets, to the
    tokens' shares to `power`.  Overall `rate` of the tokens are asked for; a cell is asked for all it has at most.
    topic: see measure.  measured: docs have been through measure already (and need no text).

    Null source, language or topic count as the empty string.  Null or empty texts have no tokens; a document in a cell
    without tokens has probability `rate`.  Null ids are drawn as the id ''.  Repeated rows are drawn alike.  An empty
    table gives an empty table.  Columns of the new names are replaced.
    """
    folder = new_folder(docs.sparkSession, "mix")
    docs = docs.drop("probability", "sampled")
    marks = docs if measured else measure(docs, text_col, topic)
    key = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    cells = stored(marks.groupBy(key(source_col).alias("m1"), key(lang_col).alias("m2"), F.col("topic").alias("m3")).agg(F.sum("n_tokens").alias("tokens")), folder, "cells")
    few = cells.count() <= small
    cells = stored(rake(cells.coalesce(1) if few else cells, targets, power, rate, sweeps, folder), folder, "raked")
    taken = {c.lower() for c in marks.columns}
    on = [next(n for k in range(len(taken) + 1) if (n := f"_{m}_{k}") not in taken) for m in MARGINS]  # names that no column of docs has
    probability = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens") * rate).otherwise(F.lit(rate)).alias("probability")
    chance = cells.select(*[F.col(m).alias(n) for m, n in zip(MARGINS, on, strict=True)], probability)
    same = (key(source_col) == F.col(on[0])) & (key(lang_col) == F.col(on[1])) & (F.col("topic") == F.col(on[2]))
    out = marks.join(F.broadcast(chance) if few else chance, same, "left").drop(*on)
    return out.withColumn("sampled", unit_hash(key(id_col), seed) < F.col("probability"))


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang"), "text")
    marks = stored(measure(docs).drop("text"), new_folder(spark, "marks"), "marks")  # the texts are read once
    return mix_sources(marks, measured=True).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "sampled")


def mixing_sql(table: str = "documents", power: float = 0.7, rate: float = 0.5, sweeps: int = SWEEPS, seed: str = "mix") -> tuple[str, str]:
    """(common table expressions, name of the table with probability and sampled) in DuckDB's SQL."""
    parts = [
        f"""t AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens, length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{SYMBOLS}', '')) AS sy,
          length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS br FROM {table})""",
        """marks AS (SELECT *, CASE WHEN 5 * sy > n_tokens THEN 'symbols' WHEN 12 * (br + 1) > n_tokens THEN 'lists' ELSE 'prose' END AS topic FROM t)""",
        """cells AS (SELECT coalesce(source, '') AS m1, coalesce(lang, '') AS m2, topic AS m3, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM marks GROUP BY ALL)""",
    ]
    for m in MARGINS:
        parts.append(f"to_{m} AS (SELECT {m}, x / sum(x) OVER () AS share FROM (SELECT {m}, pow(CAST(sum(tokens) AS DOUBLE), {power}) AS x FROM cells GROUP BY {m}))")
    parts.append("w0 AS (SELECT cells.*, to_m1.share AS m1_to, to_m2.share AS m2_to, to_m3.share AS m3_to, CAST(sum(tokens) OVER () AS DOUBLE) AS a, CAST(tokens AS DOUBLE) AS w FROM cells JOIN to_m1 USING (m1) JOIN to_m2 USING (m2) JOIN to_m3 USING (m3))")
    last = "w0"
    for k in range(sweeps):
        for m in MARGINS:
            w = f"w * ({m}_to * a / s)"
            w = f"least(CASE WHEN s > 0 THEN {w} ELSE 0.0 END, tokens / CAST({rate} AS DOUBLE))" if m == MARGINS[-1] else f"CASE WHEN s > 0 THEN {w} ELSE 0.0 END"
            parts.append(f"w{k}_{m} AS MATERIALIZED (SELECT m1, m2, m3, tokens, m1_to, m2_to, m3_to, a, {w} AS w FROM (SELECT *, sum(w) OVER (PARTITION BY {m}) AS s FROM {last}))")
            last = f"w{k}_{m}"
    parts.append(f"mixed AS (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{seed}'), 1, 13) AS BIGINT) / 4503599627370496.0 < probability AS sampled FROM (SELECT marks.*, CASE WHEN c.tokens > 0 THEN c.w / c.tokens * {rate} ELSE {rate} END AS probability FROM marks JOIN {last} c ON c.m1 = coalesce(source, '') AND c.m2 = coalesce(lang, '') AND c.m3 = topic))")
    return ",\n".join(parts), "mixed"


OP3_SQL = f"WITH {mixing_sql()[0]}\nSELECT doc_id, source, lang, topic, CAST(n_tokens AS BIGINT) AS n_tokens, round(probability, 6) AS probability, sampled FROM mixed"
