"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents are summed up to cells (one for each combination of the dimensions' values).  A mixture has a budget, a share of
all tokens, and may take a document ``repeats`` times at most.  Targets are shares of the budget for the values of each
dimension; a value that cannot give its share is taken whole and the others of its dimension make up for it.  The cells'
token weights are then raked to the targets of each dimension in turn, within what a cell can give, until all of them are
met within TOLERANCE or MOST_ROUNDS are done.  Fitted by own tokens of a cell is the rate of its documents: that many copies
of each are drawn, the fraction by chance.  The draw depends on the id alone, so it comes out alike on every run.

The topic of a document is learned from the texts, for each language by itself, so that targets of topics and languages can
be met together: topic k of a language is the k-th of its words of TOPIC_LETTERS letters or more by the number of documents
that have it, of those that at most one in COMMON has.  A document is of the topic whose word it has most often (of equals,
the one that more documents have).

Defined results: a null in a dimension is a value of its own, written as the empty string, as is no topic; null and empty
texts have no tokens, count for no weight, and take their cell's rate (1 where a whole cell has no tokens); targets for
values that do not occur are left out and the rest scaled up; values without a target are not drawn; repeated rows are drawn
alike; rows with a null id keep the null and are drawn by their text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables

#: Raking ends when each value's weight is within this part of its target.
TOLERANCE = 1e-3
#: Rounds of raking in one plan, and at most.
ROUNDS_AT_ONCE, MOST_ROUNDS = 10, 40
#: Cells up to which they are raked in one task and their rates broadcast (well under 100 bytes each).
FEW_CELLS = 100_000

TOPICS, TOPIC_LETTERS, COMMON = 12, 5, 10
WHITE = r"[\x20\x09-\x0D]+"

Targets = Mapping[str, Mapping[str, float]]


def words(text: Column) -> Column:
    """What stands between ASCII white space, in order."""
    return F.array_remove(F.split(text, WHITE, -1), "")


def topic_words(rows: DataFrame, tables: Tables) -> DataFrame:
    """(lang, topics): the words, TOPICS at most, that stand for the topics of a language, counted over all ``rows`` (lang, text)."""
    long = F.filter(F.split(F.col("text"), WHITE, -1), lambda w: F.length(w) >= TOPIC_LETTERS)
    counted = rows.select("lang", F.explode(F.array_distinct(long)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    sizes = tables.put(rows.groupBy("lang").agg(F.count("*").alias("documents")))
    if sizes.count() <= FEW_CELLS:  # a row for each language
        sizes = F.broadcast(sizes)
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    ranked = counted.join(sizes, "lang").where(F.col("n") * COMMON <= F.col("documents")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOPICS)
    return ranked.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("topics"))


def topic(places: Column) -> Column:
    """The topic that is most frequent among the numbers (from 1) of topics; '' where there is none."""
    counts = [F.struct(F.size(F.filter(places, lambda x: x == F.lit(i + 1))).alias("n"), F.lit(-i).alias("i")) for i in range(TOPICS)]  # noqa: B023
    most = F.array_max(F.array(*counts))
    return F.when(most["n"] > 0, F.concat(F.lit("topic"), 1 - most["i"])).otherwise("")


def draw(mark: Column) -> Column:
    """From 0 to 1, by the MD5 of the row's mark."""
    return F.conv(F.substring(F.md5(mark.cast("string")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def with_sum(cells: DataFrame, by: str | None, of: Column, name: str, few: bool) -> DataFrame:
    """Adds the sum of ``of`` over the cells of equal ``by``, or over all."""
    if few:  # in one partition: no shuffle
        return cells.withColumn(name, F.sum(of).over(Window.partitionBy(F.col(by) if by else F.lit(0))))
    if by is None:
        return cells.crossJoin(F.broadcast(cells.agg(F.sum(of).alias(name))))  # one row
    return cells.join(cells.groupBy(by).agg(F.sum(of).alias(name)), by)


def targets_of(cells: DataFrame, dims: list[str], targets: Targets, temper: float, few: bool) -> DataFrame:
    """Adds t_<dim>, the target share of each cell's value.

    A dimension without given targets gets its own shares to the power ``temper`` (1: as they are, 0: all alike).
    """
    out = cells
    for d in dims:
        out = with_sum(out, d, F.col("tokens"), "have", few)
        if given := targets.get(d):
            held = F.create_map(*[x for k, v in given.items() for x in (F.lit(k), F.lit(float(v)))])
            raw = F.coalesce(F.element_at(held, F.col(d)), F.lit(0.0))
        else:
            raw = F.pow(F.col("have").cast("double"), F.lit(float(temper)))
        # Each value counts once among all cells: by its cells' parts of its tokens.
        out = out.withColumn("raw", F.when(F.col("have") > 0, raw).otherwise(0.0))
        out = with_sum(out, None, F.when(F.col("have") > 0, F.col("raw") * F.col("tokens") / F.col("have")).otherwise(0.0), "total", few)
        out = out.withColumn(f"t_{d}", F.when(F.col("total") > 0, F.col("raw") / F.col("total")).otherwise(0.0)).drop("have", "raw", "total")
    return out


def sized_targets(cells: DataFrame, dims: list[str], budget: float, repeats: int) -> DataFrame:
    """Turns each t_<dim> into tokens: at most what the value can give, in proportion to the shares below that.

    Where the values with a target cannot give the budget, the size is what they can.
    """
    gives = F.col("tokens").cast("double") * repeats
    can = [F.sum(F.when(F.col(f"t_{d}") > 0, gives)).alias(d) for d in dims]
    sums = cells.agg(F.sum("tokens").alias("all_tokens"), *can).first()
    size = min([budget * (sums["all_tokens"] or 0), *[float(sums[d] or 0) for d in dims]])
    out = cells
    for d in dims:
        t = F.col(f"t_{d}")
        values = cells.where(t > 0).groupBy(d).agg(F.sum(gives).alias("gives"), F.first(t).alias("t")).withColumn("full_at", F.col("gives") / F.col("t"))
        order = Window.partitionBy(F.lit(0)).orderBy("full_at", d)  # a row for each value of one dimension
        # The scale if this value and all that fill up later are not full, and all before are.
        before = F.coalesce(F.sum("gives").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        scale = (F.lit(size) - before) / F.sum("t").over(order.rowsBetween(0, Window.unboundedFollowing))
        first = values.withColumn("scale", scale).where("scale <= full_at").agg(F.min_by("scale", F.struct("full_at", d)).alias("scale"))
        most = F.least("gives", F.coalesce(F.col("scale"), F.col("full_at")) * F.col("t"))
        wanted = values.crossJoin(F.broadcast(first)).select(d, most.alias("wanted"))
        out = out.join(wanted, d, "left").withColumn(f"t_{d}", F.coalesce("wanted", F.lit(0.0))).drop("wanted")
    return out


def rake(cells: DataFrame, dims: list[str], tables: Tables, repeats: int, few: bool) -> tuple[DataFrame, float, int]:
    """Adds weight, the tokens raked to the targets t_<dim> in turn; with it, how far the worst is off, and the rounds done.

    Cells only, never documents.
    """
    now, off, done = cells.withColumn("weight", F.col("tokens").cast("double")), 0.0, 0
    while done < MOST_ROUNDS and (not done or off > TOLERANCE):
        for _ in range(ROUNDS_AT_ONCE):
            for d in dims:
                now = with_sum(now, d, F.col("weight"), "have", few)
                raked = F.when(F.col("have") > 0, F.col("weight") * F.col(f"t_{d}") / F.col("have")).otherwise(0.0)
                now = now.withColumn("weight", F.least(raked, F.col("tokens").cast("double") * repeats)).drop("have")
        done += ROUNDS_AT_ONCE
        written = tables.put(now)
        now = written.coalesce(1) if few else written
        off = max(residual(written, d) for d in dims)
    return now, off, done


def residual(cells: DataFrame, d: str) -> float:
    """How far the values of a dimension are off their targets, as a part of them, at most."""
    values = cells.where(F.col(f"t_{d}") > 0).groupBy(d).agg(F.sum("weight").alias("have"), F.first(f"t_{d}").alias("t"))
    return values.agg(F.max(F.abs(F.col("have") / F.col("t") - 1)).alias("off")).first()["off"] or 0.0


@dataclass
class Fitted:
    """Rates of the cells, how far the worst target is missed (as a part of it), and the rounds it took."""

    cells: DataFrame
    off: float
    rounds: int
    few: bool


def fit(cells: DataFrame, dims: list[str], tables: Tables, targets: Targets | None = None, temper: float = 0.5, budget: float = 0.5, repeats: int = 1) -> Fitted:
    """``cells`` (dims, tokens) to (dims, rate)."""
    few = cells.count() <= FEW_CELLS
    cells = cells.coalesce(1) if few else cells  # in one partition, no grouping of cells needs a shuffle
    wanted = tables.put(targets_of(cells, dims, targets or {}, temper, few))
    sized = tables.put(sized_targets(wanted, dims, budget, repeats))
    fitted, off, rounds = rake(sized.coalesce(1) if few else sized, dims, tables, repeats, few)
    rate = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0)
    return Fitted(fitted.select(*dims, rate.alias("rate")), off, rounds, few)


def mix(df: DataFrame, dims: Mapping[str, Column], tokens: Column, targets: Targets | None = None, temper: float = 0.5, id_col: str = "doc_id", budget: float = 0.5, repeats: int = 1, mark: Column | None = None) -> DataFrame:
    """Per row: doc_id, the dimensions, n_tokens, rate (expected copies), copies, sampled (whether there is any).

    ``dims`` maps names to columns, ``targets`` a name to {value: share}; ``budget`` is the share of all tokens to sample.
    """
    names = list(dims)
    tables = Tables(df.sparkSession, "mixing")
    drawn = draw(F.col(id_col) if mark is None else mark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in dims.items()], F.coalesce(tokens.cast("long"), F.lit(0)).alias("n_tokens"), drawn.alias("drawn"))
    docs = tables.put(docs)  # ids and a few short values: texts are read no more
    fitted = fit(tables.put(docs.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))), names, tables, targets, temper, budget, repeats)
    whole = F.floor("rate")
    copies = (whole + F.when(F.col("drawn") < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    of = F.broadcast(fitted.cells) if fitted.few else fitted.cells
    return docs.join(of, names).select("doc_id", *names, "n_tokens", "rate", copies.alias("copies"), (copies > 0).alias("sampled"))


def mix_documents(df: DataFrame, targets: Targets | None = None, temper: float = 0.5, id_col: str = "doc_id", budget: float = 0.5, repeats: int = 1) -> DataFrame:
    """``mix`` over source, lang and topic, with words as tokens."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), "source", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tables = Tables(df.sparkSession, "topics")
    topics = tables.put(topic_words(rows, tables))
    if topics.count() <= FEW_CELLS:  # a row for each language
        topics = F.broadcast(topics)
    known = rows.join(topics, "lang", "left").withColumn("found", words(F.col("text")))
    places = F.transform(F.filter("found", lambda w: (F.length(w) >= TOPIC_LETTERS) & F.array_contains("topics", w)), lambda w: F.array_position("topics", w))
    known = known.select("doc_id", "source", "lang", F.size("found").alias("n"), F.coalesce(places, F.array().cast("array<bigint>")).alias("places"), F.coalesce(F.col("doc_id").cast("string"), F.col("text")).alias("mark"))
    return mix(known, {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col("places"))}, F.col("n"), targets, temper, "doc_id", budget, repeats, F.col("mark"))


def oracle_sql(targets: Targets, budget: float, repeats: int, temper: float = 0.5) -> str:
    """``mix_documents`` in DuckDB, with rates to 6 places."""
    dims = ["source", "lang", "topic"]
    parts = [
        f"d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents)",
        f"e AS (SELECT *, list_filter(string_split_regex(t, '{WHITE}'), lambda w: w <> '') AS ws FROM d)",
        f"f AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(list_distinct(list_filter(ws, lambda w: length(w) >= {TOPIC_LETTERS}))) AS word FROM e) GROUP BY ALL)",
        f"g AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS i FROM f JOIN (SELECT lang, count(*) AS documents FROM d GROUP BY lang) USING (lang) WHERE n * {COMMON} <= documents QUALIFY i <= {TOPICS})",
        "h AS (SELECT *, row_number() OVER () AS r, len(ws) AS n_tokens FROM e)",
        "i AS (SELECT r, lang, word, count(*) AS n FROM (SELECT r, lang, unnest(ws) AS word FROM h) GROUP BY ALL)",
        "j AS (SELECT r, 'topic' || g.i AS topic FROM i JOIN g USING (lang, word) QUALIFY row_number() OVER (PARTITION BY r ORDER BY n DESC, g.i) = 1)",
        "x AS (SELECT doc_id, t, source, lang, n_tokens, coalesce(topic, '') AS topic FROM h LEFT JOIN j USING (r))",
        "c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM x GROUP BY ALL)",
    ]
    for d in dims:
        given = targets.get(d)
        raw = "CASE " + " ".join(f"WHEN {d} = '{k}' THEN {v}" for k, v in given.items()) + " ELSE 0 END" if given else f"pow(sum(tokens), {temper})"
        parts.append(f"m_{d} AS (SELECT {d}, {repeats} * sum(tokens) AS gives, {raw} AS raw FROM c GROUP BY {d} HAVING sum(tokens) > 0)")
    parts.append(f"size AS (SELECT least({budget} * (SELECT sum(tokens) FROM c), " + ", ".join(f"(SELECT sum(gives) FROM m_{d} WHERE raw > 0)" for d in dims) + ") AS size)")
    for d in dims:
        parts.append(f"n_{d} AS (SELECT {d}, gives, raw / sum(raw) OVER () AS t, gives / (raw / sum(raw) OVER ()) AS full_at FROM m_{d} WHERE raw > 0)")
        parts.append(f"o_{d} AS (SELECT *, (size - coalesce(sum(gives) OVER (ORDER BY full_at, {d} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(t) OVER (ORDER BY full_at, {d} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM n_{d}, size)")
        parts.append(f"t_{d} AS (SELECT {d}, least(gives, coalesce((SELECT scale FROM o_{d} WHERE scale <= full_at ORDER BY full_at, {d} LIMIT 1), full_at) * t) AS t_{d} FROM n_{d})")
    columns = ", ".join(f"coalesce(t_{d}, 0) AS t_{d}" for d in dims)
    parts.append(f"w0 AS (SELECT c.*, tokens AS weight, {columns} FROM c " + " ".join(f"LEFT JOIN t_{d} USING ({d})" for d in dims) + ")")
    k, going = 0, "true"
    for block in range(MOST_ROUNDS // ROUNDS_AT_ONCE):
        for _ in range(ROUNDS_AT_ONCE):
            for d in dims:
                raked = f"CASE WHEN sum(weight) OVER (PARTITION BY {d}) > 0 THEN least(weight * t_{d} / sum(weight) OVER (PARTITION BY {d}), tokens * {repeats}) ELSE 0 END"
                parts.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {going} THEN {raked} ELSE weight END AS weight) FROM w{k})")
                k += 1
        off = ", ".join(f"(SELECT max(abs(s / t - 1)) FROM (SELECT sum(weight) AS s, first(t_{d}) AS t FROM w{k} WHERE t_{d} > 0 GROUP BY {d}))" for d in dims)
        parts.append(f"off{block} AS MATERIALIZED (SELECT greatest({off}) > {TOLERANCE} AS going)")
        going = f"(SELECT going FROM off{block})"
    parts.append(f"p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN weight / tokens ELSE 1 END AS p FROM w{k})")
    parts.append("y AS (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), t)), 1, 8) AS BIGINT) / 4294967296.0 AS drawn FROM x JOIN p USING (source, lang, topic))")
    parts.append("z AS (SELECT *, CAST(floor(p) + CASE WHEN drawn < p - floor(p) THEN 1 ELSE 0 END AS INTEGER) AS copies FROM y)")
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, source, lang, topic, CAST(n_tokens AS BIGINT) AS n_tokens, round(p, 6) AS rate, copies, copies > 0 AS sampled FROM z"
