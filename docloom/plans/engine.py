"""One object for the whole: ingest a corpus of files to stores, look into them, and answer questions in batches."""

from __future__ import annotations

import hashlib
import re
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.config import DEFAULT, Config
from docloom.functions import encodings, languages, numeric, text
from docloom.functions.garbage import is_cid_garbage
from docloom.functions.text import estimated_tokens, tokens
from docloom.operators import chunking, facts, fusion, graph, lexical, observe, records, relational, report, retrieval, tables, vectors
from docloom.plans import planner
from docloom.plans.provider import Offline
from docloom.sources import files, markup, pdf, plain, sheets
from docloom.sources.ship import ship
from docloom.streaming import events

STORES = ["documents", "parsed", "blocks", "tables", "plans", "chunks", "repaired", "facts", "entities", "columns", "nodes", "edges", "lexical", "events", "completions"]
OFFICE = r"\.(docx|pptx|xlsx)$"
#: Rounds of check and repair after ingestion.
REPAIRS = 2


def view_name(doc_id: Column, table_name: Column) -> Column:
    """The name of a document's table in SQL, unique among all documents."""
    return F.concat(F.lit("d"), F.lower(F.hex(doc_id)), F.lit("_"), table_name)


class Engine:
    """Stores are Parquet folders under `root`, partitioned by job; nothing is read back from one job into another.

    A stage that ends leaves a record in `completions` with the fingerprint of what it was made from: the
    listing of the files, the settings, and all stages before. A later ingestion of the job skips every stage whose record
    has the same fingerprint, those without rows too, and makes anew what a changed input or setting reaches.
    """

    def __init__(self, spark: SparkSession, root: str, provider: Offline | None = None, config: Config = DEFAULT, profiles: DataFrame | None = None):
        """profiles: languages.profiles of texts whose language is known; without them frequent words of four languages tell a file's language."""
        self.spark, self.root, self.provider, self.config = spark, root, provider or Offline(), config
        self.tell = text.language if profiles is None else languages.detector(profiles)
        ship(spark)

    # Ingestion
    def ingest(self, path: str, job_id: str, pipeline: str = "custom") -> None:
        """All files of a folder to stores; a file that cannot be read is a row with its error. No text is cut.

        Every document goes through all steps, or with the pipeline `agent` through those of its plan (`plans`),
        after which checks look for tables without a summary and documents without a node and make what is
        missing. Each stage that runs leaves its start and its end in the event log, and all its Spark work carries
        the job's tag, by which it can be cancelled.
        """
        self.spark.addTag(job_id)
        try:
            self._ingest(path, job_id, pipeline)
        finally:
            self.spark.removeTag(job_id)

    def ingest_all(self, path: str, jobs: dict[str, str]) -> dict[str, str | None]:
        """The same folder by several pipelines at once, each to a job of its own (pipeline: job). Returns each job's error, None for those that went through; a job that fails leaves the others alone."""

        def one(pipeline: str, job_id: str) -> str | None:
            try:
                self.ingest(path, job_id, pipeline)
            except Exception as e:  # noqa: BLE001 - told to the caller, and in the event log
                return f"{type(e).__name__}: {e}"[:300]

        if len(set(jobs.values())) < len(jobs):
            raise ValueError("each pipeline needs a job of its own")
        with ThreadPoolExecutor(max(1, len(jobs))) as pool:
            runs = {job: pool.submit(inheritable_thread_target(self.spark)(one), pipeline, job) for pipeline, job in jobs.items()}
        return {job: run.result() for job, run in runs.items()}

    def _ingest(self, path: str, job_id: str, pipeline: str) -> None:
        raw = files.raw_files(self.spark, path).withColumn("doc_id", F.xxhash64("path"))
        listed = raw.select(F.xxhash64("path", "length", "modificationTime").alias("h")).agg(F.count("*"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
        print_ = f"{tuple(listed)}|{pipeline}|{self.config}|{type(self.provider).__name__}"
        done = self._completed(job_id)
        of = lambda key: self._of(key, job_id)
        # blocks keep the lines of a fact, which chunks join
        lines = lambda: of("blocks").select(F.format_string("%d_b%04d", "doc_id", "pos").alias("block_id"), "text")
        makers = {
            "documents": lambda: files.intake(raw, self.tell).withColumn("doc_id", F.xxhash64("path")),
            "parsed": lambda: self._parsed(raw, of("documents")),
            "blocks": lambda: self._blocks(of("parsed")),
            "tables": lambda: self._tables(of("parsed")),
            "plans": lambda: self._plans(of("documents"), of("blocks"), of("tables"), of("parsed"), pipeline),
            "chunks": lambda: self._chunks(of("blocks"), of("tables"), of("plans"), job_id, pipeline),
            "repaired": lambda: self._repaired(of("tables"), of("chunks"), job_id, pipeline),
            "facts": lambda: facts.validate(self.provider.facts(lines(), "block_id"), lines(), "block_id").where("accepted"),
            "entities": lambda: self.provider.entities(self._with_step(self.chunks_of(job_id).select("doc_id", "chunk_id", "text"), of("plans"), "entities"), "chunk_id"),
            "columns": lambda: self._columns(self._with_step(of("tables"), of("plans"), "sql_store")),
            "nodes": lambda: self._graph(job_id)["nodes"],
            "edges": lambda: self._graph(job_id)["edges"],
            "lexical": lambda: self._lexical(job_id),
        }
        for number, (key, make) in enumerate(makers.items(), 1):
            print_ = hashlib.sha256(f"{print_}|{key}".encode()).hexdigest()
            if done.get(key) != print_:
                self._stage(number, key, job_id, print_, make)

    def _completed(self, job_id: str) -> dict[str, str]:
        """By stage the fingerprint of its last completion."""
        df = self._table("completions")
        if df is None:
            return {}
        return {r.stage: r.fingerprint for r in df.where(F.col("job_id") == job_id).groupBy("stage").agg(F.max_by("fingerprint", "ts").alias("fingerprint")).collect()}

    def _stage(self, stage_id: int, key: str, job_id: str, fingerprint: str, make) -> None:
        began = time.monotonic()
        self._event(job_id, stage_id, key, "started")
        try:
            files.write_artifact(make().withColumn("job_id", F.lit(job_id)), self.root, key, of=job_id)
        except Exception as e:
            self._event(job_id, stage_id, key, "error", began, f"{type(e).__name__}: {e}"[:300])
            raise
        row = self.spark.range(1).select(F.lit(key).alias("stage"), F.lit(stage_id).alias("stage_id"), F.lit(fingerprint).alias("fingerprint"), F.current_timestamp().alias("ts"), F.lit(job_id).alias("job_id"))
        files.append_artifact(row, self.root, "completions")
        self._event(job_id, stage_id, key, "completed", began)

    def _event(self, job_id: str, stage_id: int, stage: str, status: str, began: float | None = None, payload: str | None = None) -> None:
        took = None if began is None else round((time.monotonic() - began) * 1000)
        row = self.spark.range(1).select(F.lit(stage_id).alias("stage_id"), F.lit(stage).alias("stage"), F.current_timestamp().alias("ts"), F.lit(status).alias("status"), F.lit(took).cast("long").alias("duration_ms"), F.lit(payload).cast("string").alias("payload"), F.lit(job_id).alias("job_id"))
        files.append_artifact(row, self.root, "events")

    def stages(self, job_id: str | None = None) -> DataFrame:
        """(job_id, stage_id, events, status, duration_ms, payload): the latest state of each stage."""
        return events.reduce_events(self._of("events", job_id), ["job_id", "stage_id"], ["ts", "status"])

    def status(self, job_id: str | None = None) -> DataFrame:
        """(job_id, run_status)."""
        return events.run_status(self.stages(job_id))

    def _table(self, key: str) -> DataFrame | None:
        return files.read_artifact(self.spark, self.root, key)

    def _of(self, key: str, job_id: str | None) -> DataFrame:
        df = self._table(key)
        if df is None:
            raise LookupError(f"nothing is stored as {key}")
        return df if job_id is None else df.where(F.col("job_id") == job_id)

    def _parsed(self, raw: DataFrame, info: DataFrame) -> DataFrame:
        """What the parsers find, each file by the parser of its kind: (doc_id, kind, pos, level, text, table_pos, headers, rows, sheet, images, error)."""
        names = ["doc_id", "kind", "pos", "level", "text", "table_pos", "headers", "rows", "sheet", "images", "error"]
        types = {"kind": "string", "pos": "long", "level": "int", "text": "string", "table_pos": "long", "headers": "array<string>", "rows": "array<array<string>>", "sheet": "string", "images": "long", "error": "string"}
        shaped = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in names])
        binary = F.col("mime").rlike("^(image/|application/(pdf|zip|msword|vnd|x-ole))") | F.lower("path").rlike(OFFICE)
        read = raw.join(info.select("doc_id", "mime"), "doc_id").withColumn("text", encodings.decoded(F.when(~binary, F.col("content")))["text"]).where("text IS NOT NULL")
        office = files.office(raw.where(F.lower("path").rlike(OFFICE))).withColumn("doc_id", F.xxhash64("path"))
        web = markup.pages(read.where("mime = 'text/html'"), "doc_id", "text")
        other = read.where("mime <> 'text/html'").select("doc_id", "text", "mime", "path")
        marked = plain.markdown_blocks(other.select("doc_id", "text")).where(F.col("text").rlike(r"\S")).withColumn("kind", F.lit("block"))
        listed = files.delimited(other.where("mime = 'text/csv' OR lower(path) LIKE '%.tsv'")).withColumn("kind", F.lit("table"))
        paged = self._pdf_rows(raw.join(info.where("mime = 'application/pdf'").select("doc_id"), "doc_id"), types)
        return reduce(DataFrame.unionByName, map(shaped, (office, web, marked, listed, paged)))

    def _pdf_rows(self, raw: DataFrame, types: dict[str, str]) -> DataFrame:
        """Rows of PDF files: each page (its text layer and number of larger images), its block, and the tables that the provider sees on it. A page without a sound layer is read from its largest image."""
        found = pdf.judged(pdf.pages(raw))
        held = F.filter("images", lambda i: i["bytes"].isNotNull())
        largest = F.array_max(F.transform(held, lambda i: F.struct((i["width"] * i["height"]).alias("area"), i["format"].alias("format"), i["bytes"].alias("bytes"))))
        asked = F.when((F.col("layer") != "native") & F.col("page").isNotNull(), largest)
        read = found.withColumn("asked", asked).withColumn("read", pdf.structured(self.provider.read_page(F.col("asked.bytes"), F.col("asked.format"))))
        rich = read.withColumn("said", F.coalesce("clean", F.nullif("read.prose", F.lit("")))).withColumn("n", F.size(F.filter("images", lambda i: i["width"] * i["height"] >= records.LEAST_AREA)))

        def row(kind: str, **values: Column) -> Column:
            known = {"kind": F.lit(kind), "pos": F.col("page") - 1, "level": F.lit(0)} | values
            return F.struct(*[known.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()])

        page = F.when(F.col("page").isNull(), row("error", error=F.col("error"))).otherwise(row("pdf_page", text=F.col("text"), images=F.col("n"), error=F.col("error")))
        block = F.when(F.col("said").isNotNull(), row("block", text=F.col("said")))
        seen = F.transform("read.tables", lambda t, i: row("table", table_pos=(F.col("page") - 1) * 1000 + i, headers=t["headers"], rows=t["rows"]))
        return rich.select("doc_id", F.inline(F.concat(F.array_compact(F.array(page, block)), seen)))

    def _blocks(self, parsed: DataFrame) -> DataFrame:
        return parsed.where("kind = 'block'").select("doc_id", "pos", "level", "text")

    def _tables(self, parsed: DataFrame) -> DataFrame:
        found = parsed.where("kind = 'table'").select("doc_id", "table_pos", "headers", "rows")
        cells = parsed.where("kind = 'sheet_row'").select(F.col("doc_id").alias("doc"), "sheet", F.col("pos").alias("row_no"), F.col("rows")[0].alias("cells"))
        place = F.row_number().over(Window.partitionBy("doc").orderBy("sheet", "island")) - 1
        book = sheets.sheet_tables(cells, None).withColumn("table_pos", place.cast("long")).select(F.col("doc").alias("doc_id"), "table_pos", "headers", "rows")
        return found.unionByName(book).withColumn("table_name", F.format_string("doc_table_%d", F.col("table_pos") + 1)).withColumn("description", self.provider.describe_table(F.col("headers"), F.size("rows")))

    def _plans(self, info: DataFrame, blocks: DataFrame, made: DataFrame, parsed: DataFrame, pipeline: str) -> DataFrame:
        """Each document's facts, classification, parser and steps; without an agent all steps."""
        n = lambda df, name, value: df.groupBy("doc_id").agg(value.alias(name))
        counts = [n(blocks, "words", F.sum(F.size(tokens(F.col("text"))))), n(made, "n_tables", F.count("*")), n(parsed, "n_images", F.coalesce(F.sum("images"), F.lit(0))), records.samples(blocks, made)]
        own = info.select("doc_id", "mime")
        shown = parsed.where("kind = 'pdf_page'").select("doc_id", F.col("pos").alias("page"), "text")
        coded = shown.groupBy("doc_id").agg(F.count("*").cast("int").alias("pages"), F.bool_or(is_cid_garbage(F.col("text"))).alias("cid_coded"))
        counts += [plain.ocr_fraction(shown).select("doc_id", "ocr_fraction"), coded]
        own = reduce(lambda a, b: a.join(b, "doc_id", "left"), counts, own)
        own = own.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("words", "n_tables", "n_images")})
        own = own.withColumn("intel", self.provider.classify(F.col("sample"), F.col("n_tables") > 0, F.col("n_images") > 0)).select("*", "intel.*").drop("intel", "sample")
        planned = self.provider.plan(own)
        return planned if pipeline == "agent" else planned.withColumn("steps", F.array(*map(F.lit, planner.STEPS)))

    def _with_step(self, df: DataFrame, plans: DataFrame, step: str) -> DataFrame:
        """Rows of the documents whose plan has a step."""
        return df.join(plans.where(F.array_contains("steps", step)).select("doc_id"), "doc_id", "left_semi")

    def _summaries(self, made: DataFrame) -> DataFrame:
        """(doc_id, pos, text, heading_path, table_name, chunk_type, token_count): what a table's summary chunk says."""
        told = sheets.summary_text(F.col("table_name"), F.col("description"), F.col("headers"), F.col("rows"))
        out = made.select("doc_id", (F.col("table_pos") + 1_000_000).alias("pos"), told.alias("text"), F.lit(None).cast("string").alias("heading_path"), "table_name", F.lit("table_summary").alias("chunk_type"))
        return out.where("text <> ''").withColumn("token_count", estimated_tokens(F.col("text")))

    def _chunks(self, blocks: DataFrame, made: DataFrame, plans: DataFrame, job_id: str, pipeline: str) -> DataFrame:
        text = self._with_step(blocks, plans, "chunk")
        prose = chunking.heading_chunks(text, config=self.config).select("doc_id", F.col("chunk_pos").alias("pos"), "text", "token_count", "heading_path", F.lit(None).cast("string").alias("table_name"), F.lit("prose").alias("chunk_type"))
        # rows of tables whose text is in no block, all of them
        every = replace(self.config, chunk_least=0)
        rows = chunking.table_chunks(self._with_step(made, plans, "chunk").withColumn("table_id", F.struct("doc_id", "table_pos", "table_name")), "table_id", every)
        rows = rows.select("table_id.doc_id", (F.col("table_id.table_pos") * 1_000_000 + F.col("chunk_pos") + 2_000_000_000).alias("pos"), "text", "token_count", F.lit(None).cast("string").alias("heading_path"), F.lit(None).cast("string").alias("table_name"), F.lit("table_rows").alias("chunk_type"))
        both = chunking.with_ids(reduce(DataFrame.unionByName, [prose, self._summaries(self._with_step(made, plans, "describe_tables")), rows]), job_id, pipeline, ["pos"])
        return chunking.split_oversize(both, self.config).withColumn("embedding", self.provider.embed(F.col("text")))

    def _repaired(self, made: DataFrame, chunks: DataFrame, job_id: str, pipeline: str) -> DataFrame:
        """Chunks that the checks after ingestion miss: summaries of tables, and the beginning of documents that have blocks or tables but no chunk. Checks follow each repair, REPAIRS rounds at most; what is missing then is in the event log."""
        blocks, found = self._of("blocks", job_id), chunks.limit(0)
        for n in range(REPAIRS + 1):
            have = chunks.unionByName(found)
            missing = planner.invariants(made, have.where("chunk_type = 'table_summary'"), have.select("doc_id").unionByName(have.select("doc_id")))
            bare = blocks.join(have.select("doc_id").distinct(), "doc_id", "left_anti")
            wanted = missing.where("missing = 'summary'").select("doc_id", "table_name")
            lost, silent = wanted.count(), bare.select("doc_id").distinct().count()
            if not lost and not silent:
                break
            self._event(job_id, 900 + n, "auto.repair", "completed" if n < REPAIRS else "error", payload=f"{lost} table summaries and {silent} documents without a chunk")
            if n == REPAIRS:
                break
            told = self._summaries(made.join(wanted, ["doc_id", "table_name"], "left_semi"))
            whole = bare.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("b")).select("doc_id", F.lit(0).cast("long").alias("pos"), F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("text"), F.lit(None).cast("string").alias("heading_path"), F.lit(None).cast("string").alias("table_name"), F.lit("prose").alias("chunk_type"))
            whole = whole.where("trim(text) <> ''").withColumn("token_count", estimated_tokens(F.col("text")))
            more = chunking.with_ids(told.unionByName(whole), f"{job_id[:7]}r", pipeline, ["pos"])
            more = chunking.split_oversize(more, self.config).withColumn("embedding", self.provider.embed(F.col("text"))).withColumn("job_id", F.lit(job_id))
            found = found.unionByName(more.select(*found.columns))
        return found.drop("job_id")

    def _columns(self, made: DataFrame) -> DataFrame:
        """(doc_id, source, table_name, pos, column, type): every stored table's columns with the types of their cells. table_name is that of the view for SQL, source its name in the document."""
        own = made.select("doc_id", F.col("table_name").alias("source"), view_name(F.col("doc_id"), F.col("table_name")).alias("table_name"), "headers", "rows")
        heads = tables.unique_names(own.select("doc_id", "source", "table_name", F.posexplode("headers").alias("pos", "header")), ["table_name"]).withColumnRenamed("name", "column")
        cells = own.select("table_name", F.explode("rows").alias("r")).select("table_name", F.posexplode("r").alias("pos", "cell"))
        kinds = tables.infer_types(cells, ["table_name", "pos"]).select("table_name", "pos", "type")
        return heads.join(kinds, ["table_name", "pos"], "left").select("doc_id", "source", "table_name", "pos", "column", F.coalesce("type", F.lit("TEXT")).alias("type"))

    def _lexical(self, job_id: str) -> DataFrame:
        """The job's shards of the lexical index, with entities as tags."""
        tagged = self._of("entities", job_id).groupBy("chunk_id").agg(F.collect_set("entity").alias("tags"))
        own = self.chunks_of(job_id).select(F.xxhash64("chunk_id").alias("key"), "chunk_id", "text").join(tagged, "chunk_id", "left")
        return lexical.shards(own, "key", tags="tags")

    # Looking into the stores
    def documents(self, job_id: str | None = None) -> DataFrame:
        return self._of("documents", job_id)

    def chunks_of(self, job_id: str | None = None) -> DataFrame:
        """All chunks, those of the repair too."""
        found = self._of("chunks", job_id)
        return found if self._table("repaired") is None else found.unionByName(self._of("repaired", job_id))

    def chunks(self, job_id: str | None = None, chunk_type: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        df = self.chunks_of(job_id)
        df = df if chunk_type is None else df.where(F.coalesce("chunk_type", F.lit("prose")) == chunk_type)
        return relational.page(df, ["chunk_id"], limit, offset)

    def table(self, doc_id: int, table_name: str, job_id: str | None = None) -> DataFrame:
        """A document's table, typed: one column for each header."""
        row = self._of("tables", job_id).where((F.col("doc_id") == doc_id) & (F.col("table_name") == table_name)).select("headers", "rows")
        first = row.select("headers").first()
        if first is None:
            raise LookupError(f"{table_name} is not in the registry")
        known = self.columns(job_id).where((F.col("doc_id") == doc_id) & (F.col("source") == table_name)).orderBy("pos").collect()  # a header's cells
        cells = row.select(F.posexplode("rows").alias("row_no", "r"))
        wide = cells.select("row_no", *[F.coalesce(F.try_element_at("r", F.lit(i + 1)), F.lit("")).alias(c["column"]) for i, c in enumerate(known)])
        return tables.typed(wide, {c["column"]: c["type"] for c in known})

    def facts(self, job_id: str | None = None) -> DataFrame:
        return self._of("facts", job_id)

    def _graph(self, job_id: str | None) -> dict[str, DataFrame]:
        chunks, found = self.chunks_of(job_id), self._of("entities", job_id)
        told = chunks.where("table_name IS NOT NULL").select("doc_id", "table_name", "chunk_id")
        return {"nodes": graph.nodes(chunks.select("doc_id", "chunk_id"), found, told), "edges": graph.edges(chunks.select("doc_id", "chunk_id"), found, told)}

    def graph(self, job_id: str | None = None) -> dict[str, DataFrame]:
        """Documents, their chunks and tables, and the entities of these."""
        return {key: self._of(key, job_id) if self._table(key) is not None else df for key, df in self._graph(job_id).items()}

    def storage_summary(self) -> DataFrame:
        """(store, rows, bytes, detail): every store; detail has facts by type, chunks by kind, rows of typed tables and nodes by type."""
        held = {k: t for k in STORES if (t := self._table(k)) is not None}
        sizes = self.spark.createDataFrame([(k, files.artifact_bytes(self.spark, self.root, k)) for k in held], "store string, bytes long")
        parts = {"facts": ("facts", "fact_type"), "chunks": ("chunks", "chunk_type"), "nodes": ("nodes", "type")}
        counts = [held[k].groupBy(F.lit(k).alias("store"), F.coalesce(F.col(c), F.lit("none")).alias("part")).agg(F.count("*").alias("n")) for k, c in parts.values() if k in held and c in held[k].columns]
        if "tables" in held:
            counts.append(held["tables"].select(F.lit("tables").alias("store"), view_name(F.col("doc_id"), F.col("table_name")).alias("part"), F.size("rows").cast("long").alias("n")))
        out = observe.storage_survey(held).join(sizes, "store")
        if not counts:
            return out.withColumn("detail", F.lit(None).cast("map<string,bigint>"))
        detail = reduce(DataFrame.unionByName, counts).groupBy("store").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("part", "n")))).alias("detail"))
        return out.join(detail, "store", "left")

    def job_summary(self, usage: DataFrame, totals: DataFrame | None = None) -> DataFrame:
        """A job's cost with its stages as rows. totals (job_id, cost) are what a provider has billed; the higher of both counts."""
        out = observe.job_cost(usage, ["job_id"])
        if totals is not None:
            out = out.join(totals.select("job_id", F.col("cost").alias("__billed")), "job_id", "left").withColumn("cost", F.greatest("cost", F.coalesce("__billed", F.lit(0.0)))).drop("__billed")
        if "stage" not in usage.columns:
            return out
        rows = observe.stage_costs(usage, ["job_id"])
        stages = rows.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("place", "stage", "cost", "wall_ms"))).alias("stages"))
        return out.join(stages, "job_id", "left")

    # Questions
    def columns(self, job_id: str | None = None) -> DataFrame:
        """(doc_id, source, table_name, pos, column, type) of every stored table, as typed when it was stored."""
        return self._of("columns", job_id)

    def sql_answers(self, questions: DataFrame, job_id: str | None = None) -> DataFrame:
        """(q) -> (q, sql, sql_value, sql_block, sql_rows, reason): the provider routes, the guards decide for all questions at once, and each distinct statement that passes is run once, several at a time."""
        known = self.columns(job_id)
        routed = self.provider.route(questions.select("q").distinct(), known).withColumn("reason", tables.refusal(F.col("sql"), F.col("q"))).collect()  # texts of statements, one for each question
        wanted = [r["sql"] for r in routed if r["reason"] is None]
        named = {v for sql in wanted for v in re.findall(r"(?i)\b(?:FROM|JOIN)\s+(\w+)", sql)}
        views = {r["table_name"]: (r["doc_id"], r["source"]) for r in known.select("table_name", "doc_id", "source").distinct().where(F.col("table_name").isin(sorted(named))).collect()} if named else {}
        for view, (doc_id, name) in views.items():
            self.table(doc_id, name, job_id).createOrReplaceTempView(view)
        results = tables.run_statements(self.spark, wanted)
        out = []
        for r in routed:
            columns, rows, reason = results[r["sql"]] if r["reason"] is None else ([], [], r["reason"])
            value = str(rows[0][0]) if len(rows) == 1 and len(rows[0]) == 1 and rows[0][0] is not None else None
            block = "\n".join([" | ".join(columns), *(" | ".join("" if v is None else str(v) for v in row) for row in rows[:5])]) if rows else None
            out.append((r["q"], r["sql"], value, block, len(rows), reason))
        return self.spark.createDataFrame(out, "q string, sql string, sql_value string, sql_block string, sql_rows int, reason string")

    def fact_answers(self, asked: DataFrame, job_id: str | None = None) -> DataFrame:
        """(question_id, embedding) -> (question_id, label, value, quote): the fact whose label is nearest the question, if near enough."""
        own = self._of("facts", job_id).withColumn("fact_id", F.xxhash64("block_id", "pos")).withColumn("vector", self.provider.embed(F.col("label")))
        best = facts.match_questions(asked.select("question_id", F.col("embedding").alias("vector")), own.select("fact_id", "vector"))
        return best.join(own.select("fact_id", "label", "value", "quote"), "fact_id").drop("fact_id", "score")

    def ask(self, questions: DataFrame, job_id: str | None = None, k: int = DEFAULT.top_k, candidates: int = 50, rerank: bool = True) -> DataFrame:
        """(question_id long, q, and keywords if known) -> answer records.

        Chunks by fused lexical, dense and graph ranks; only the dense list is cut (to `candidates`). The
        fact nearest the question and the result of a routed SQL statement come before them in the context;
        a lone number that SQL gives must be near one in the chunks, and yields to a fact. Chunks are reranked
        where there are more than `k` and no SQL result. With keywords (array), the answer is judged by them.
        """
        chunks = self.chunks_of(job_id).select(F.xxhash64("chunk_id").alias("key"), "chunk_id", "text", "embedding")
        asked = questions.select("question_id", F.col("q").alias("text"), self.provider.embed(F.col("q")).alias("embedding"))
        dense = vectors.dense_top(chunks, asked, candidates, "question_id", "key")
        index = self._of("lexical", job_id) if self._table("lexical") is not None else self._lexical(job_id)
        ranked = fusion.graph_top(index, asked, dense, DEFAULT.retrieve_k, candidates, "question_id", "key")
        held = ranked.join(chunks.select("key", "chunk_id", "text"), "key")
        top = held.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("c"))  # at most retrieve_k chunks
        top = questions.join(top, "question_id", "left").withColumn("c", F.coalesce("c", F.array().cast("array<struct<rank:bigint,chunk_id:string,text:string>>")))
        if self._table("tables") is not None:
            top = top.join(self.sql_answers(questions, job_id), "q", "left")
        else:
            top = top.selectExpr("*", *[f"CAST(null AS {kind}) AS {name}" for name, kind in (("sql", "string"), ("sql_value", "string"), ("sql_block", "string"), ("sql_rows", "int"), ("reason", "string"))])
        if self._table("facts") is not None:
            top = top.join(self.fact_answers(asked, job_id), "question_id", "left")
        else:
            top = top.selectExpr("*", *[f"CAST(null AS string) AS {name}" for name in ("label", "value", "quote")])
        texts = lambda c: F.transform(c, lambda x: x["text"])
        number = F.col("sql_value").try_cast("double")
        doubtful = number.isNotNull() & ~tables.plausible(number, texts(F.col("c")))
        covered = number.isNotNull() & tables.overlaps_fact(numeric.parse_number(F.col("value")), number)
        top = top.withColumn("reason", F.when(F.col("reason") != "ok", F.col("reason")).when(doubtful, "implausible").when(covered, "covered_by_fact").otherwise(F.coalesce("reason", F.lit("not_routed"))))
        top = top.withColumn("has_sql", F.col("reason") == "ok").withColumn("sql_block", F.when(F.col("has_sql"), F.col("sql_block")))
        order = F.when(retrieval.should_rerank(F.size("c"), F.lit(rerank), F.when(F.col("has_sql"), F.col("sql_rows")).otherwise(0)), self.provider.rerank(F.col("q"), texts(F.col("c"))))
        order = retrieval.reranked(F.coalesce(order, F.array().cast("array<int>")), k, F.size("c"))
        top = top.withColumn("c", F.when(F.size("c") > 0, F.transform(order, lambda i: F.element_at(F.col("c"), (i + 1).cast("int")))).otherwise(F.col("c")))
        fact = F.when(F.col("label").isNotNull(), facts.block(F.col("label"), F.col("value"), F.col("quote")))
        route = F.concat_ws("+", F.when(F.col("has_sql"), "sql"), F.when(F.col("label").isNotNull(), "facts"), F.when(F.size("c") > 0, "vector"))
        # what comes before the chunks is the first text that an answer is made of
        before = F.filter(F.array(fact), lambda t: t.isNotNull())
        answers = top.withColumns({
            "chunk_ids": F.transform("c", lambda c: c["chunk_id"]), "route": route, "context": retrieval.context(fact, F.col("sql_block"), texts(F.col("c"))),
            "answer": self.provider.answer(F.concat(before, texts(F.col("c"))), F.when(F.col("has_sql"), F.coalesce("sql_value", "sql_block")).otherwise(F.lit(""))),
        })
        if "keywords" in questions.columns:
            score, verdict = self.provider.judge(F.col("answer"), F.col("keywords"))
            answers = answers.withColumns({"judge_score": score, "verdict": verdict})
        sure = retrieval.confidence(top.select("question_id", "has_sql").join(held.drop("has_sql"), "question_id", "left"), "question_id")
        return records.answer_record(answers.drop("c", "label", "value", "quote")).join(sure, "question_id", "left")

    def report(self, answers: DataFrame, path: str) -> None:
        """The evaluation report of answers that `ask` has judged."""
        # answers are computed once: both files are made of what is stored
        kept = f"{path}/answers"
        answers.withColumnRenamed("judge_score", "score").drop("keywords").write.mode("overwrite").parquet(kept)
        report.write_report(self.spark.read.parquet(kept), path)

    def question_bank(self, job_id: str | None = None, most: int = 10) -> DataFrame:
        """Ten questions at most for a job's tables and entities: SQL questions first, then one for each of the most mentioned entities."""
        sql = tables.table_questions(self.columns(job_id).select("table_name", "column", "type")).select("route", "q", F.lit(0).alias("o"))
        named = graph.top_entities(self._of("entities", job_id), key="chunk_id").select(F.lit("vector").alias("route"), F.concat(F.lit("What is said about "), F.regexp_replace("entity", "^[A-Z]+:", ""), F.lit("?")).alias("q"), F.lit(1).alias("o"))
        return sql.unionByName(named).orderBy("o", "q").limit(most).select("route", "q")

    def run_sql(self, sql: str, question: str) -> tuple[DataFrame | None, str]:
        return tables.run_guarded(self.spark, sql, question)

    def cancel(self, job_id: str) -> None:
        """Stop the Spark work that runs under a job's tag, and mark the run as cancelled."""
        self.spark.interruptTag(job_id)
        self._event(job_id, events.CANCELLED, "run", "cancelled")

    @staticmethod
    def compare(runs: dict[str, DataFrame]) -> DataFrame:
        """The same results of two pipelines, side by side as one table with its pipeline."""
        return reduce(DataFrame.unionByName, [df.withColumn("pipeline", F.lit(name)) for name, df in runs.items()])


