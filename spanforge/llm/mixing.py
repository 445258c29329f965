"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

The token weights of the cells source x language x topic are raked to the three marginals in turn until they fit,
then each document is taken with its cell's calibrated probability. All of it looks at cells, which are summed before
anything moves; documents meet the finished cells in one join whose small side the planner broadcasts only if its
written size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import settled

SPACED = r"[^\x20\x09-\x0D]+"
ROUNDS = 8
TEMPER = 0.7
BUDGET = 0.6
SEED = 7
DIMENSIONS = ("source", "lang", "topic")


def topic_of(text: Column, n: Column) -> Column:
    """The layout of a text, for tables without a topic: none, rows (cells between bars), notes, prose or long."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return F.when(n == 0, "none").when(bars * 20 > n, "rows").when(n < 100, "notes").when(n < 1000, "prose").otherwise("long")


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the first 13 hex digits of md5(seed:doc_id); a null id draws as the word null."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))


def described(docs: DataFrame, text: str = "text", topic: str | None = None) -> DataFrame:
    """(row, source, lang, topic, tokens) of each row, all its columns in the struct `row`.

    A null source, lang or topic is the value (none), a null text is empty. topic names a column of docs; without one
    the layout of a text is its topic. A column that only happens to be called topic isn't read.
    """
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    body = F.coalesce(F.col("row").getField(text), F.lit(""))
    n = F.regexp_count(body, F.lit(SPACED)).cast("long")
    kind = F.col("row").getField(topic).cast("string") if topic else topic_of(body, n)
    none = F.lit("(none)")
    return packed.select("row", F.coalesce("row.source", none).alias("source"), F.coalesce("row.lang", none).alias("lang"), F.coalesce(kind, none).alias("topic"), n.alias("tokens"))


def targets(cells: DataFrame, by: str, temper: float = TEMPER) -> DataFrame:
    """Target share of each value: its token share to the power `temper`, made to sum to one."""
    sums = cells.groupBy(by).agg(F.sum("tokens").alias("_t"))
    return sums.select(F.col(by), F.pow(F.col("_t").cast("double"), F.lit(temper)).alias("_p"))


def raked(cells: DataFrame, temper: float = TEMPER, rounds: int = ROUNDS, goals: dict[str, DataFrame] | None = None) -> DataFrame:
    """The cells (with tokens > 0) and `weight`: shares that sum to one and fit the target marginals.

    goals: for a dimension, a table (dimension, share) in place of the tempered shares. Values without a goal are
    left out. The number of rounds is fixed, so a result doesn't depend on a tolerance.
    """
    cells = cells.where("tokens > 0")
    total = Window.partitionBy(F.lit(0))
    for d in DIMENSIONS:
        want = goals[d].select(F.col(d), F.col("share").cast("double").alias("_p")) if goals and d in goals else targets(cells, d, temper)
        want = want.select(F.col(d).alias(f"_{d}"), (F.col("_p") / F.sum("_p").over(total)).alias(f"want_{d}"))
        cells = cells.join(want, cells[d] == want[f"_{d}"]).drop(f"_{d}")
    out = settled(cells.withColumn("weight", F.col("tokens").cast("double")))
    for k in range(rounds):
        for d in DIMENSIONS:
            out = out.withColumn("weight", F.col("weight") * F.col(f"want_{d}") / F.sum("weight").over(Window.partitionBy(d)))
        if k % 4 == 3:
            out = settled(out)
    return out


def calibrated(cells: DataFrame, budget: float = BUDGET, passes: int = 4) -> DataFrame:
    """`probability` of each raked cell: scale x weight / tokens, at most one.

    The scale is set so that the expected tokens are `budget` of all; what cells at one can't give is spread over the
    others, `passes` times.
    """
    over = Window.partitionBy(F.lit(0))
    out = cells.withColumn("ratio", F.col("weight") / F.col("tokens")).withColumn("all_tokens", F.sum("tokens").over(over).cast("double"))
    out = out.withColumn("scale", F.lit(budget) * F.col("all_tokens") / F.sum("weight").over(over))
    for _ in range(passes):
        full = F.col("scale") * F.col("ratio") >= 1
        held = F.sum(F.when(full, F.col("tokens")).otherwise(0)).over(over)
        free = F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("weight"))).over(over)
        out = out.withColumn("scale", F.when(free > 0, F.greatest(F.col("scale"), (F.lit(budget) * F.col("all_tokens") - held) / free)).otherwise(F.col("scale")))
    return out.withColumn("probability", F.least(F.lit(1.0), F.col("scale") * F.col("ratio")))


def weighed(docs: DataFrame, text: str = "text", topic: str | None = None, temper: float = TEMPER, budget: float = BUDGET, rounds: int = ROUNDS, goals: dict[str, DataFrame] | None = None) -> DataFrame:
    """described() with `weight` and `probability` of each row's cell: 0 and 1 for rows without a word, which cost nothing.

    A cell that goals leave out gets weight 0 and probability 0.
    """
    rows = described(docs, text, topic)
    cells = settled(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    fitted = settled(calibrated(raked(cells, temper, rounds, goals), budget).select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], F.round("weight", 9).alias("weight"), F.round("probability", 9).alias("probability")))
    joined = rows.join(fitted, [rows[d] == fitted[f"_{d}"] for d in DIMENSIONS], "left")
    without = F.when(F.col("tokens") > 0, 0.0).otherwise(1.0)
    return joined.select("row", *DIMENSIONS, "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("probability", without).alias("probability"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, **more) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, target_weight, probability, taken) of every row of docs.

    target_weight: the share of the mixture's tokens that the row's cell should have. Rows without a word (null and
    empty texts) have no token weight: weight 0, probability 1, taken. Null sources and languages are a value of their
    own; null ids draw as one id. Repeated rows with one id share their draw, and a draw equal to the probability isn't
    taken. An empty table gives no rows; further columns are ignored, also one called topic. more: see weighed().
    """
    rows = weighed(docs, text, **more)
    taken = draw(F.col("row").getField(doc_id), seed) < F.col("probability")
    return rows.select(F.col("row").getField(doc_id).alias("doc_id"), *DIMENSIONS, "tokens", F.col("weight").alias("target_weight"), "probability", taken.alias("taken"))


def sampled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, **more) -> DataFrame:
    """The rows of docs that mix() takes, with all their columns, whatever these are called, in the row's own place."""
    rows = weighed(docs, text, **more)
    return rows.where(draw(F.col("row").getField(doc_id), seed) < F.col("probability")).select("row.*")


def oracle(temper: float = TEMPER, budget: float = BUDGET, rounds: int = ROUNDS, seed: int = SEED, passes: int = 4) -> str:
    """DuckDB SQL for mix() over the view documents."""
    step = ["WITH described AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS tokens, length(coalesce(text, '')) - length(replace(coalesce(text, ''), '|', '')) AS bars FROM documents)"]
    step.append("rows_ AS (SELECT doc_id, source, lang, CASE WHEN tokens = 0 THEN 'none' WHEN bars * 20 > tokens THEN 'rows' WHEN tokens < 100 THEN 'notes' WHEN tokens < 1000 THEN 'prose' ELSE 'long' END AS topic, tokens FROM described)")
    step.append("cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM rows_ GROUP BY ALL HAVING sum(tokens) > 0)")
    for d in DIMENSIONS:
        step.append(f"p_{d} AS (SELECT {d}, pow(CAST(sum(tokens) AS DOUBLE), {temper}) AS p FROM cells GROUP BY {d})")
        step.append(f"want_{d} AS (SELECT {d}, p / sum(p) OVER () AS want_{d} FROM p_{d})")
    step.append("w0 AS (SELECT *, CAST(tokens AS DOUBLE) AS weight FROM cells JOIN want_source USING (source) JOIN want_lang USING (lang) JOIN want_topic USING (topic))")
    k = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            step.append(f"w{k + 1} AS (SELECT * REPLACE (weight * want_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight) FROM w{k})")
            k += 1
    step.append(f"s0 AS (SELECT *, weight / tokens AS ratio, CAST(sum(tokens) OVER () AS DOUBLE) AS all_tokens, {budget} * CAST(sum(tokens) OVER () AS DOUBLE) / sum(weight) OVER () AS scale FROM w{k})")
    for i in range(passes):
        step.append(f"h{i} AS (SELECT *, sum(CASE WHEN scale * ratio >= 1 THEN tokens ELSE 0 END) OVER () AS held, sum(CASE WHEN scale * ratio >= 1 THEN 0.0 ELSE weight END) OVER () AS free FROM s{i})")
        step.append(f"s{i + 1} AS (SELECT * EXCLUDE (held, free) REPLACE (CASE WHEN free > 0 THEN greatest(scale, ({budget} * all_tokens - held) / free) ELSE scale END AS scale) FROM h{i})")
    step.append(f"fitted AS (SELECT source, lang, topic, weight, least(1.0, scale * ratio) AS probability FROM s{passes})")
    step.append(f"joined AS (SELECT r.*, coalesce(round(f.weight, 9), 0.0) AS target_weight, coalesce(round(f.probability, 9), 1.0) AS probability, CAST(CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / {float(16**13)} AS u FROM rows_ r LEFT JOIN fitted f USING (source, lang, topic))")
    return ", ".join(step) + " SELECT doc_id, source, lang, topic, CAST(tokens AS BIGINT) AS tokens, target_weight, probability, u < probability AS taken FROM joined"
