"""Chunks of documents: a heading-aware fold, word windows, table rows; and their statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import DEFAULT, Config
from docloom.functions.text import SPACES_SQL, estimate, tokens

#: Deepest heading level that breadcrumbs tell apart.
LEVELS = 9


def words_for(tokens_: int, config: Config = DEFAULT) -> int:
    return int(tokens_ / config.tokens_per_word)


def _tokens(words: int, config: Config) -> int:
    return max(1, int(words * config.tokens_per_word)) if words else 0


def cuts(words: list[int], levels: list[int], config: Config = DEFAULT) -> list[tuple[int, int, int]]:
    """Where a document's chunks lie, from the words and heading levels (0: body) of its blocks alone: (first block, end, words of overlap).

    A chunk is a run of blocks after the last words of the blocks before it. It ends before a body block
    that would take it past the target (the next chunk then overlaps it) and before a heading (then it
    does not); one under the least is no chunk: its words go on into the next, or are lost at the end.
    """
    found, first, overlap, held, size = [], 0, 0, 0, 0
    for i, (n, level) in enumerate(zip(words, levels, strict=True)):
        past = not level and size > 0 and size + _tokens(n, config) > config.chunk_target
        if past or level and size >= config.chunk_least:
            if size >= config.chunk_least:
                found.append((first, i, overlap))
            first, overlap = i, min(held, words_for(config.chunk_overlap, config)) if past else 0
            held, size = overlap, _tokens(overlap, config)
        held, size = held + n, size + _tokens(n, config)
    return found + [(first, len(words), overlap)] * (size >= config.chunk_least)


def _breadcrumbs(blocks: DataFrame, key: str) -> DataFrame:
    """blocks with heading_path: the headings above each block and itself, joined by ` > `.

    A heading's depth is its level, but at most one more than the depth before it: over a document's
    headings the least of level less number so far, plus the number. The text at each depth is that of the last
    heading there.
    """
    so_far = Window.partitionBy(key).orderBy("pos")
    heading = F.col("level") > 0
    df = blocks.withColumn("nth", F.sum(heading.cast("int")).over(so_far))
    least = F.min(F.when(heading, F.least(F.col("level"), F.lit(LEVELS)) - F.col("nth"))).over(so_far)
    df = df.withColumn("depth", F.when(heading, F.col("nth") + F.least(F.lit(0), least)))
    above = F.array(*[F.last(F.when(F.col("depth") == d, F.col("text")), ignorenulls=True).over(so_far) for d in range(1, LEVELS + 1)])
    here = F.coalesce(F.last("depth", ignorenulls=True).over(so_far), F.lit(0)).cast("int")
    return df.withColumn("heading_path", F.when(here > 0, F.array_join(F.slice(above, F.lit(1), here), " > "))).drop("depth")


def heading_chunks(blocks: DataFrame, key: str = "doc_id", page: str | None = None, config: Config = DEFAULT) -> DataFrame:
    """(key, pos, level, text) -> (key, chunk_pos, text, token_count, page, heading_path).

    Blank blocks are left out. A chunk's page is the last one known at its end since the last heading, its
    heading_path that of its last block. A document whose blocks make no chunk gives its whole text, in
    windows if it is long. Where chunks end is found from counts alone; texts never leave the JVM.
    """
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    own = blocks.select(key, "pos", F.coalesce(F.col("level").cast("int"), F.lit(0)).alias("level"), text.alias("text"), (F.col(page).cast("int") if page else F.lit(None).cast("int")).alias("page")).where("text <> ''")
    own = _breadcrumbs(own, key).withColumn("n", F.size(tokens(F.col("text"))))
    own = own.withColumn("page_now", F.last("page", ignorenulls=True).over(Window.partitionBy(key, "nth").orderBy("pos")))
    docs = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "level", "text", "n", "page", "page_now", "heading_path"))).alias("b"))

    @F.pandas_udf("array<int>")
    def found(words: pd.Series, levels: pd.Series) -> pd.Series:
        return pd.Series([[x for cut in cuts(list(w), list(lv), config) for x in cut] for w, lv in zip(words, levels, strict=True)])

    docs = docs.withColumn("texts", F.col("b.text")).withColumn("cut", found(F.col("b.n"), F.col("b.level")))

    def chunk(k: Column) -> Column:
        first, end, overlap = (F.element_at("cut", 3 * k + i) for i in (1, 2, 3))
        # every block has a word, so that many blocks hold the overlap
        before = tokens(F.array_join(F.slice("texts", F.greatest(F.lit(1), first - overlap + 1), F.least(first, overlap)), " "))
        tail = F.slice(before, F.greatest(F.lit(1), F.size(before) - overlap + 1), overlap)
        said = F.array_join(F.concat(tail, F.slice("texts", first + 1, end - first)), " ")
        last = F.element_at("b", end)
        return F.struct(said.alias("text"), last["page_now"].alias("page"), last["heading_path"].alias("heading_path"))

    whole = F.array_join("texts", "\n\n")
    width, step = words_for(config.fallback_tokens, config), words_for(config.fallback_tokens, config) - words_for(config.window_overlap, config)
    words = tokens(whole)
    last = F.greatest(F.lit(0), F.ceil((F.size(words) - width) / F.lit(step))).cast("int")
    bare = lambda t: F.struct(t.alias("text"), F.element_at("b", 1)["page"].alias("page"), F.lit(None).cast("string").alias("heading_path"))
    long = F.transform(F.sequence(F.lit(0), last), lambda k: bare(F.array_join(F.slice(words, k * step + 1, F.lit(width)), " ")))
    rest = F.when(estimate(F.size(words)) <= config.fallback_tokens, F.array(bare(whole))).otherwise(long)
    made = F.when(F.size("cut") > 0, F.transform(F.sequence(F.lit(0), (F.size("cut") / 3).cast("int") - 1), chunk)).otherwise(rest)
    out = docs.select(key, F.posexplode(made).alias("chunk_pos", "c"))
    return out.select(key, F.col("chunk_pos").cast("long"), "c.text", estimate(F.size(tokens(F.col("c.text")))).alias("token_count"), "c.page", "c.heading_path")


def small_groups(sizes: list[int], words: list[int], config: Config = DEFAULT) -> list[int]:
    """For each of a document's chunks the group that it is merged into: a group ends with the chunk that brings it to the least; what is left at the end joins the group before, as a negative number less one."""
    out, group, held = [], 0, 0
    for size, n in zip(sizes, words, strict=True):
        out.append(group)
        held += n
        if (size if held == n else _tokens(held, config)) >= config.chunk_least:
            group, held = group + 1, 0
    return [-g if g == group and g else g for g in out]


def merge_small(chunks: DataFrame, key: str = "doc_id", config: Config = DEFAULT) -> DataFrame:
    """(key, chunk_pos, text, token_count, page, heading_path): chunks under the least go into the next one, the last ones into the one before; positions are given anew.

    A chunk keeps the first heading and page of those that went into it from before. A lone chunk stays as it is.
    """
    own = chunks.select(key, F.struct("chunk_pos", "text", "token_count", F.size(tokens(F.col("text"))).alias("n"), "page", F.nullif("heading_path", F.lit("")).alias("heading_path")).alias("c"))
    docs = own.groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("c"))

    @F.pandas_udf("array<int>")
    def groups(sizes: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([small_groups(list(s), list(w), config) for s, w in zip(sizes, words, strict=True)])

    docs = docs.withColumn("g", groups(F.col("c.token_count"), F.col("c.n")))
    rows = docs.select(key, F.posexplode(F.arrays_zip("c", "g")).alias("at", "x")).select(key, "at", "x.c.*", "x.g")
    # -1 is the group before the one left over, which there is unless nothing reached the least
    rows = rows.withColumns({"into": F.when(F.col("g") < 0, -F.col("g") - 1).otherwise(F.col("g")), "own": F.col("g") >= 0})
    first = lambda c: F.min_by(c, F.when(F.col("own") & F.col(c).isNotNull(), F.col("at")))
    out = rows.groupBy(key, "into").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("held"), F.min("token_count").alias("one"), first("page").alias("page"), first("heading_path").alias("heading_path"))
    out = out.withColumn("text", F.when(F.size("held") == 1, F.col("held")[0]["text"]).otherwise(F.trim(F.array_join(F.transform("held", lambda x: x["text"]), " "))))
    count = F.when(F.size("held") == 1, F.col("one")).otherwise(estimate(F.size(tokens(F.col("text")))))
    return out.select(key, F.col("into").cast("long").alias("chunk_pos"), "text", count.alias("token_count"), "page", "heading_path")


def windows(docs: DataFrame, width: int, overlap: int, key: str = "doc_id", text: Column | None = None) -> DataFrame:
    """(key, window, start_word, n_words, text): word windows of a width that overlap; the last is the first that reaches the end. No rows for a text without words."""
    words = docs.select(key, tokens(F.col("text") if text is None else text).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - width) / F.lit(width - overlap)))
    rows = words.select(key, "w", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("window"))
    start = F.col("window") * (width - overlap)
    rows = rows.select(key, F.col("window").cast("long"), start.cast("long").alias("start_word"), F.slice("w", start + 1, F.lit(width)).alias("part"))
    return rows.select(key, "window", "start_word", F.size("part").cast("long").alias("n_words"), F.array_join("part", " ").alias("text"))


def split_oversize(chunks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(chunk_id, text, token_count, …): chunks over the limit as parts `<id>_part_<nn>` that keep the other columns, and split_from and split_index; others unchanged."""
    big = chunks.where(F.col("token_count") > config.oversize_tokens)
    rest = chunks.where(F.col("token_count") <= config.oversize_tokens).withColumns({"split_from": F.lit(None).cast("string"), "split_index": F.lit(None).cast("int")})
    width, overlap = words_for(config.oversize_window, config), words_for(config.window_overlap, config)
    parts = windows(big, width, overlap, "chunk_id").select(F.col("chunk_id").alias("split_from"), F.col("window").cast("int").alias("split_index"), F.col("text").alias("part"), "n_words")
    parts = parts.join(big, F.col("split_from") == F.col("chunk_id"))
    named = parts.withColumns({"chunk_id": F.format_string("%s_part_%02d", "split_from", "split_index"), "text": F.col("part"), "token_count": estimate(F.col("n_words"))})
    return rest.unionByName(named.select(*rest.columns))


def row_batches(words: list[int], header: int, config: Config = DEFAULT) -> list[int]:
    """For each of a table's rows the text that it is packed into, from the words of rows and header alone: as many as stay within the target. A last one under the least is -1, dropped."""
    out, batch, held = [], 0, 0
    for n in words:
        if held and _tokens(header + held + n, config) > config.chunk_target:
            batch, held = batch + 1, 0
        out.append(batch)
        held += n
    return [-1 if k == batch and max(1, _tokens(header + held, config)) < config.chunk_least else k for k in out]


def table_chunks(tables: DataFrame, key: str = "table_id", config: Config = DEFAULT) -> DataFrame:
    """(key, headers, rows) -> (key, chunk_pos, text, token_count): rows packed up to the target, each text with the header."""

    @F.pandas_udf("array<int>")
    def batches(words: pd.Series, header: pd.Series) -> pd.Series:
        return pd.Series([row_batches(list(w), int(h), config) for w, h in zip(words, header, strict=True)])

    count = lambda t: F.size(tokens(t))
    lines = tables.select(key, F.array_join("headers", " | ").alias("head"), F.transform("rows", lambda r: F.array_join(r, " | ")).alias("lines")).where(F.size("lines") > 0)
    lines = lines.withColumn("batch", batches(F.transform("lines", count), count(F.col("head"))))
    rows = lines.select(key, "head", F.posexplode(F.arrays_zip("lines", "batch")).alias("at", "x")).where("x.batch >= 0")
    held = rows.groupBy(key, F.col("x.batch").cast("long").alias("chunk_pos")).agg(F.first("head").alias("head"), F.array_sort(F.collect_list(F.struct("at", "x.lines"))).alias("held"))
    out = held.withColumn("text", F.concat_ws("\n", "head", F.transform("held", lambda x: x["lines"])))
    return out.select(key, "chunk_pos", "text", estimate(count(F.col("text"))).alias("token_count"))


def with_ids(chunks: DataFrame, job: str, pipeline: str, order: list[str]) -> DataFrame:
    """Chunk ids `<job>_<pipeline>_c<nnnn>` within a document, in order."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
    return chunks.withColumn("chunk_id", F.format_string("%s_%s_d%s_c%04d", F.substring(F.lit(job), 1, 8), F.lit(pipeline), F.col("doc_id").cast("string"), place))


def stats(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number, mean (to 1 place), least, most and total of the chunks' tokens."""
    n = F.col("token_count")
    return chunks.groupBy(*(by or [])).agg(F.count("*").alias("chunks"), F.round(F.avg(n), 1).alias("avg_tokens"), F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"), F.sum(n).alias("total_tokens"))


def coverage(total_tokens: Column, word_count: Column) -> Column:
    """Percent of a document's estimated tokens that its chunks hold, at most 100."""
    return F.round(F.least(F.lit(100.0), total_tokens * 100.0 / estimate(word_count)), 1)


def histogram(chunks: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, low, chunks) for each of ten equal bins from the least to the most tokens, empty ones too."""
    ends = chunks.agg(F.min("token_count").alias("lo"), F.max("token_count").alias("hi"))
    ends = ends.withColumn("width", F.greatest(F.lit(1), F.floor((F.col("hi") - F.col("lo") + 1) / bins)).cast("long"))
    # one row of ends: joined to the chunks it is a constant
    placed = chunks.join(F.broadcast(ends)).select(F.least(F.lit(bins - 1), F.floor((F.col("token_count") - F.col("lo")) / F.col("width"))).cast("long").alias("bin"))
    counted = placed.groupBy("bin").agg(F.count("*").alias("chunks"))
    all_bins = ends.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"), "lo", "width")
    return all_bins.join(counted, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


# Queries. The windows are small so that most documents have several.
WIDTH, OVERLAP = 222, 47


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _windows(spark, sf_dir):
    return windows(_documents(spark, sf_dir).select("doc_id", "text"), WIDTH, OVERLAP)


def _chunks(spark, sf_dir):
    return _windows(spark, sf_dir).withColumn("token_count", estimate(F.col("n_words")))


def _token_estimate(spark, sf_dir):
    n = F.size(tokens(F.col("text")))
    return _documents(spark, sf_dir).select("doc_id", n.cast("long").alias("n_words"), estimate(n).alias("token_count"))


def _coverage(spark, sf_dir):
    whole = _documents(spark, sf_dir).select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("word_count"))
    per_doc = stats(_chunks(spark, sf_dir), ["doc_id"]).join(whole, "doc_id")
    return per_doc.withColumn("coverage", coverage(F.col("total_tokens"), F.col("word_count")))


W = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES_SQL}'), lambda t: t <> '')"
EST = "CAST(greatest(1, floor({} * 1.35::DOUBLE)) AS BIGINT)"
_WINDOWS_SQL = f"""
WITH d AS (SELECT doc_id, {W} AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - {WIDTH}) / {WIDTH - OVERLAP}.0)) AS BIGINT) + 1)) AS k FROM d WHERE len(w) > 0),
c AS (SELECT doc_id, k AS win, k * {WIDTH - OVERLAP} AS start_word, w[k * {WIDTH - OVERLAP} + 1 : k * {WIDTH - OVERLAP} + {WIDTH}] AS part FROM x),
ch AS (SELECT doc_id, win, start_word, CAST(len(part) AS BIGINT) AS n_words, array_to_string(part, ' ') AS text, {EST.format("len(part)")} AS token_count FROM c)
"""
QUERIES = {
    "token_estimate": (_token_estimate, f"SELECT doc_id, CAST(len({W}) AS BIGINT) AS n_words, {EST.format(f'len({W})')} AS token_count FROM documents"),
    "chunk_windows": (lambda s, d: _windows(s, d).select("doc_id", "window", "start_word", "n_words", F.md5("text").alias("text_md5")), _WINDOWS_SQL + 'SELECT doc_id, win AS "window", start_word, n_words, md5(text) AS text_md5 FROM ch'),
    "chunk_stats": (lambda s, d: stats(_chunks(s, d)), _WINDOWS_SQL + "SELECT count(*) AS chunks, round(avg(token_count), 1) AS avg_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens, CAST(sum(token_count) AS BIGINT) AS total_tokens FROM ch"),
    "chunk_coverage": (
        _coverage,
        _WINDOWS_SQL
        + f""", s AS (SELECT doc_id, count(*) AS chunks, round(avg(token_count), 1) AS avg_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens, CAST(sum(token_count) AS BIGINT) AS total_tokens FROM ch GROUP BY doc_id)
SELECT s.*, CAST(len(w) AS BIGINT) AS word_count, round(least(100.0::DOUBLE, total_tokens * 100.0::DOUBLE / {EST.format("len(w)")}), 1) AS coverage FROM s JOIN d USING (doc_id)""",
    ),
    "chunk_histogram": (
        lambda s, d: histogram(_chunks(s, d)),
        _WINDOWS_SQL
        + """, e AS (SELECT min(token_count) AS lo, greatest(1, (max(token_count) - min(token_count) + 1) // 10) AS width FROM ch),
p AS (SELECT least(9, (token_count - lo) // width) AS bin, count(*) AS n FROM ch, e GROUP BY 1)
SELECT b.bin, CAST(lo + b.bin * width AS BIGINT) AS low, coalesce(n, 0) AS chunks FROM (SELECT unnest(range(10)) AS bin) b CROSS JOIN e LEFT JOIN p USING (bin)""",
    ),
    "oversize_split": (
        lambda s, d: split_oversize(_documents(s, d).select(F.col("doc_id").cast("string").alias("chunk_id"), "text", estimate(F.size(tokens(F.col("text")))).alias("token_count")), Config(oversize_tokens=1000, oversize_window=1000)).select("chunk_id", "token_count", "split_from", F.coalesce("split_index", F.lit(-1)).cast("long").alias("split_index")),
        f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, {W} AS w FROM documents), e AS (SELECT *, {EST.format("len(w)")} AS n FROM d),
x AS (SELECT id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 740) / 592.0)) AS BIGINT) + 1)) AS k FROM e WHERE n > 1000)
SELECT id AS chunk_id, n AS token_count, NULL::VARCHAR AS split_from, -1::BIGINT AS split_index FROM e WHERE n <= 1000
UNION ALL SELECT id || '_part_' || lpad(CAST(k AS VARCHAR), 2, '0'), {EST.format("len(w[k * 592 + 1 : k * 592 + 740])")}, id, k FROM x""",
    ),
}
