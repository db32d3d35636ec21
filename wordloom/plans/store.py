"""The vocabulary store: an append-only log in Parquet, and views over it.

::

    <root>/sentences/stream=S/batch_id=N   every non-blank sentence of the batch
    <root>/facts/…                         one row per sentence and word
    <root>/progress/…                      per source: last sentence index, size and hash of its text
    <root>/sources/…                       sources first met in the batch, where pages were taken in
    <root>/rejected/…                      what the batch did not take, and why
    <root>/retracted/…                     sources taken back, and up to which commit
    <root>/definitions/…                   definitions found for words by a back-fill
    <root>/batches/…                       written last; a batch without it does not exist
    <root>/views/<name>/version=K          words, sources, sentences, word_sources, word_contexts
    <root>/view_versions                   written after the view; readers take the latest
                                           (a refresh removes versions before the one that is the latest when it begins)

A batch is known by its stream and its number there: batch jobs are one stream, every
streaming query is another, named by its checkpoint. A committed batch is final: asked to write it
again (a driver was lost between the commit and the query's own), the store returns what it
has. A batch that failed has no row in ``batches``, so its folders are overwritten by the retry and
read by nobody before. ``seq`` numbers the commits; whatever is to be first or last goes by it.
One writer at a time; any number of readers.
"""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions.text import empty_if_null, text_id
from wordloom.operators import dictionary as lookups
from wordloom.operators import views
from wordloom.operators.layout import broadcast_if_small, estimated_bytes
from wordloom.operators.sentences import distinct_sentences
from wordloom.schemas import DEFINITIONS, FACTS, SENTENCES, SOURCES
from wordloom.session import shuffles_dropped

#: The stream of batch jobs.
JOBS = "jobs"
KEY = ["stream", "batch_id"]
KEY_FIELDS = [T.StructField("stream", T.StringType()), T.StructField("batch_id", T.LongType())]
PROGRESS = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("last_processed", T.LongType()),
        T.StructField("text_sentences", T.LongType()),
        T.StructField("content_id", T.StringType()),
    ]
)
REJECTED = T.StructType(
    [T.StructField("source_id", T.StringType()), T.StructField("reason", T.StringType())]
)
RETRACTED = T.StructType(
    [T.StructField("source_id", T.StringType()), T.StructField("up_to", T.LongType())]
)
FOUND_DEFINITIONS = T.StructType(
    [T.StructField("word_id", T.StringType()), T.StructField("definitions", DEFINITIONS)]
)
BATCHES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("sentences", T.LongType()),
        T.StructField("links", T.LongType()),
        T.StructField("committed_at", T.TimestampType()),
    ]
)
#: ``seq``: the last commit that a version holds; null where the writer gave rows of its own.
VERSIONS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)
#: View -> the columns it is laid out by.
VIEWS = {
    "sentences": None,
    "sources": None,
    "words": ["word"],
    "word_sources": ["source_id", "word"],
    "word_contexts": ["source_id", "word"],
}
#: How tables are written: with Zstandard, which halves the hexadecimal digits of ids, and with dictionaries that hold
#: the words of a file, some 200,000 and as many ids, where the usual 1 MiB is full after a tenth of them.
FILES = {"compression": "zstd", "parquet.dictionary.page.size": str(16 << 20)}
#: The log's bytes of facts that one task gets where a view is laid out by pairs.
PAIR_BYTES = 8 << 20
PAIR = ["source_id", "word"]
#: Views that are in ranges of ``PAIR`` already, which ``write_view`` need not shuffle again.
_LAID_OUT: WeakKeyDictionary[DataFrame, list[str]] = WeakKeyDictionary()
#: How such a view is made of those of its input rows that meet a condition, in so many slices of all.
_SLICED: WeakKeyDictionary[DataFrame, Callable[[Column, int], DataFrame]] = WeakKeyDictionary()
#: The log's bytes of facts from which a view of pairs is written in slices, one for each so many bytes, and the most slices.
SLICE_BYTES, SLICES = 64 << 20, 4
#: Sources that are looked at, at most, to find where slices begin.
SLICE_SAMPLE = 20_000


class VocabularyStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- log ---------------------------------------------------------------------

    def write_part(self, table: str, batch_id: int, rows: DataFrame, stream: str = JOBS) -> DataFrame:
        """Write one table of a batch and return the rows as read back."""
        path = f"{self.root}/{table}/stream={stream}/batch_id={batch_id}"
        _write(rows, path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def write_counted(
        self, table: str, batch_id: int, rows: DataFrame, total: Column, stream: str = JOBS
    ) -> tuple[DataFrame, int]:
        """``write_part`` and a total over the rows, heard while they are written: nothing is read for it.

        The observed rows are those the writing tasks put out, each task once, however often it was tried.
        """
        heard = Observation()
        written = self.write_part(table, batch_id, rows.observe(heard, total.alias("total")), stream)
        return written, heard.get.get("total") or 0

    def commit(self, batch_id: int, sentences: int = 0, links: int = 0, stream: str = JOBS) -> Row:
        """Make a batch visible. Call it after all other tables of the batch are written."""
        if (done := self.committed(batch_id, stream)) is not None:
            return done
        seq = self.last_seq() + 1
        rows = self.spark.createDataFrame([(seq, sentences, links, None)], BATCHES)
        rows = rows.withColumn("committed_at", F.current_timestamp())
        self.write_part("batches", batch_id, rows.coalesce(1), stream)
        return self.committed(batch_id, stream)

    def committed(self, batch_id: int, stream: str = JOBS) -> Row | None:
        """The row of a committed batch, else nothing."""
        return self.batches().where((F.col("stream") == stream) & (F.col("batch_id") == batch_id)).first()

    def _read(self, path: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{path}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        return self._read(name, T.StructType([*schema.fields, *KEY_FIELDS]))

    def batches(self) -> DataFrame:
        return self._table("batches", BATCHES)

    def last_seq(self) -> int:
        """Number of the last commit, -1 before the first."""
        last = self.batches().agg(F.max("seq")).first()[0]
        return -1 if last is None else last

    def next_batch_id(self, stream: str = JOBS) -> int:
        last = self.batches().where(F.col("stream") == stream).agg(F.max("batch_id")).first()[0]
        return 0 if last is None else last + 1

    def log(self, name: str, schema: T.StructType, after: int | None = None) -> DataFrame:
        """Rows of committed batches with the ``seq`` and the time of their commit.

        ``after`` leaves out commits up to that one: their folders are pruned by name, not read and filtered.
        """
        known = self.batches().select(*KEY, "seq", F.col("committed_at").alias("ingested_at"))
        rows = self._table(name, schema)
        if after is not None:
            known = known.where(F.col("seq") > after)
            folders: dict[str, list[int]] = {}
            for r in known.select(*KEY).collect():  # a row per commit since then
                folders.setdefault(r["stream"], []).append(r["batch_id"])
            wanted = F.lit(False)
            for stream, ids in folders.items():
                wanted |= (F.col("stream") == stream) & F.col("batch_id").isin(ids)
            rows = rows.where(wanted)
        return rows.join(broadcast_if_small(known), KEY).drop(*KEY)

    def _live(self, name: str, schema: T.StructType, after: int | None = None) -> DataFrame:
        """The log without what was taken back after it was committed."""
        taken = self.log("retracted", RETRACTED).groupBy("source_id").agg(F.max("up_to").alias("up_to"))
        if taken.isEmpty():
            return self.log(name, schema, after)
        taken = taken.withColumnRenamed("source_id", "gone_id")
        gone = (F.col("source_id") == F.col("gone_id")) & (F.col("seq") <= F.col("up_to"))
        return self.log(name, schema, after).join(broadcast_if_small(taken), gone, "left_anti")

    def sentences(self, after: int | None = None) -> DataFrame:
        return self._live("sentences", SENTENCES, after)

    def facts(self, after: int | None = None) -> DataFrame:
        return self._live("facts", FACTS, after)

    def progress(self) -> DataFrame:
        """Per source: last sentence index, number of sentences and hash of its latest text."""
        last = F.max_by(F.struct("last_processed", "text_sentences", "content_id"), "last_processed")
        return self._live("progress", PROGRESS).groupBy("source_id").agg(last.alias("p")).select("source_id", "p.*")

    def known_sources(self) -> DataFrame:
        """Each source once, as it was first met."""
        row = F.struct(*SOURCES.fieldNames()[1:])
        first = self._live("sources", SOURCES).groupBy("source_id").agg(F.min_by(row, "seq").alias("row"))
        return first.select("source_id", "row.*")

    def rejected(self) -> DataFrame:
        return self.log("rejected", REJECTED).select(*REJECTED.fieldNames())

    def retract(self, sources: DataFrame) -> None:
        """Take sources back: all views, progress and known sources lose what was committed of them so far.

        They may be taken in again afterwards.
        """
        batch_id = self.next_batch_id("retractions")
        ids = sources.select(F.col("source_id").cast("string").alias("source_id")).distinct()
        rows = ids.withColumn("up_to", F.lit(self.last_seq()).cast("bigint"))
        self.write_part("retracted", batch_id, rows, "retractions")
        self.commit(batch_id, stream="retractions")

    def backfill(self, matches: DataFrame) -> int:
        """Look up the words that have no definitions yet and keep what is found; return how many."""
        todo = self.view("words").where("definitions IS NULL")  # read back from the log
        found = lookups.backfill_definitions(todo, matches).where("updated")
        batch_id = self.next_batch_id("definitions")
        rows = found.select(*FOUND_DEFINITIONS.fieldNames())
        _, n = self.write_counted("definitions", batch_id, rows, F.count(F.lit(1)), "definitions")
        self.commit(batch_id, stream="definitions")
        return n

    # -- views -------------------------------------------------------------------

    def view(self, name: str, matches: DataFrame | None = None) -> DataFrame:
        """A view computed from the log: one of ``VIEWS``."""
        if name == "words":
            return self._words(self._occurrences(), matches)
        if name == "word_sources":
            return self._links(_linked(self.facts()))
        if name == "word_contexts":
            return self._contexts(_placed(self.facts()))
        if name == "sentences":
            return distinct_sentences(self.sentences())
        if name == "sources":
            progress = self.progress().select("source_id", "last_processed")
            return self.known_sources().join(progress, "source_id", "left").select(
                *SOURCES.fieldNames(),
                F.coalesce("last_processed", F.lit(-1)).alias("last_processed_sentence"),
            )
        raise ValueError(f"no view {name!r}")

    def _occurrences(self, after: int | None = None) -> DataFrame:
        return self.facts(after).select(
            "word",
            F.col("word").alias("lemma"),
            "language",
            F.col("reading").alias("pronunciation"),
            "seq",
            "source_id",
            "sentence_idx",
            "first_token_idx",
        )

    def _words(self, occurrences: DataFrame, matches: DataFrame | None) -> DataFrame:
        # A later commit wins, whatever its sources are called.
        order = ["seq", "source_id", "sentence_idx", "first_token_idx"]
        # Choosing the last reading sorts; occurrences without one decide nothing and are folded to their words before.
        read = F.coalesce(F.col("pronunciation") != "", F.lit(False))
        silent = occurrences.where(~read).select("word", "lemma", "language").distinct()
        for c in ("pronunciation", *order):
            silent = silent.withColumn(c, F.lit(None).cast(occurrences.schema[c].dataType))
        merged = views.upsert_words(occurrences.where(read).unionByName(silent), order)
        merged = merged.withColumn("token_reading", F.col("pronunciation"))
        enriched = lookups.enrich_words(merged.withColumnRenamed("pronunciation", "reading"), matches)
        kept = self.log("definitions", FOUND_DEFINITIONS)
        kept = kept.groupBy("word_id").agg(F.max_by("definitions", "seq").alias("kept"))
        return enriched.join(kept, "word_id", "left").select(
            "word_id",
            "word",
            "lemma",
            "language",
            "pronunciation",
            F.lit(None).cast("string").alias("image_url"),
            F.lit(None).cast("string").alias("mnemonic_text"),
            F.coalesce(F.when(F.size("definitions") > 0, F.col("definitions")), "kept").alias("definitions"),
            "token_reading",
        )

    def _versions(self) -> DataFrame:
        return self._read("view_versions", VERSIONS)

    def _version(self, name: str, field: str = "version") -> int | None:
        own = self._versions().where(F.col("name") == name)
        return own.agg(F.max_by(field, "version")).first()[0]

    def write_view(
        self, name: str, rows: DataFrame, order: list[str] | None = None, seq: int | None = None
    ) -> DataFrame:
        """Write a new version of a view, laid out in ``order`` where given, and make it the one that is read.

        Range partitions sorted by (source_id, word) let a reader that wants one source
        skip all other files and row groups; a source too large for one range is split
        by word. Readers of the version before are not disturbed. Links and contexts as ``view``
        gives them are in such ranges already and are not moved again. Those of a large log are made in slices
        of sources, one after the other, so that the disk holds the shuffle of one slice beside the view.
        """
        last = self._version(name)
        version = 0 if last is None else last + 1
        path = f"{self.root}/views/{name}/version={version}"
        for n, part in enumerate(self._slices(rows) if _LAID_OUT.get(rows) == order else [rows]):
            if order:
                ranged = part if _LAID_OUT.get(rows) == order else part.repartitionByRange(*order)
                part = ranged.sortWithinPartitions(*order)
            _write(part, path, "append" if n else "overwrite")
        pointer = self.spark.createDataFrame([(name, version, seq)], VERSIONS)
        pointer.coalesce(1).write.mode("append").parquet(f"{self.root}/view_versions")
        return self.read_view(name)

    def write_views(self, matches: DataFrame | None = None) -> None:
        """Write all views from the log."""
        seq = self.last_seq()
        for name, order in VIEWS.items():
            self.write_view(name, self.view(name, matches), order, seq)

    def refresh_views(self, matches: DataFrame | None = None) -> None:
        """Bring all views up to the last commit."""
        for name in VIEWS:
            self.refresh_view(name, matches)

    def refresh_view(self, name: str, matches: DataFrame | None = None) -> DataFrame:
        """Bring a written view up to the last commit by what was committed since, and return it.

        Every view is a fold that takes its own rows as input: the rows of the last version and the facts of later
        commits go through the aggregation that makes the view from the whole log, and give the same rows.
        The log before is not read. Links and contexts of sources that were taken back since leave the last
        version first; words and sentences, which do not say whose they are, are then made from the whole log, as
        are views that were never written, or written with rows of the caller's own. The list of sources
        is small beside the log and always made anew. A dictionary is looked up for all words of the view.
        Versions before the last one go first, so the disk holds the last, whose readers are not disturbed, and the new one.
        """
        seq, done = self.last_seq(), self._version(name, "seq")
        if done == seq and matches is None:
            return self.read_view(name)
        self._drop_versions(name, self._version(name))
        rows = None if done is None else self._refreshed(name, done, matches)
        return self.write_view(name, self.view(name, matches) if rows is None else rows, VIEWS[name], seq)

    def _drop_versions(self, name: str, last: int | None) -> None:
        """Remove the versions of a view that are older than ``last``."""
        if last is None:
            return
        context = self.spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/views/{name}")
        files = folder.getFileSystem(context._jsc.hadoopConfiguration())
        for status in files.listStatus(folder):
            path = status.getPath()
            key, _, version = path.getName().partition("=")
            if key == "version" and version.isdigit() and int(version) < last:
                files.delete(path, True)

    def _refreshed(self, name: str, done: int, matches: DataFrame | None) -> DataFrame | None:
        """The view from its last version, which holds all commits up to ``done``; nothing if that cannot be."""
        old = self.read_view(name)
        gone = self.log("retracted", RETRACTED, after=done).select("source_id").distinct()
        taken_back = not gone.isEmpty()
        if name in ("word_sources", "word_contexts") and taken_back:
            old = old.join(broadcast_if_small(gone), "source_id", "left_anti")
        if name == "word_sources":
            if "language" not in old.columns:  # written before links had it
                return None
            known = old.select(
                "source_id", "word", "language",
                F.col("occurrence_count").alias("n"),
                F.col("last_sentence_idx").alias("sentence_idx"),
                F.unhex("context_sentence_id").alias("sentence_id"),
                F.col("first_seen_at").alias("ingested_at"),
            )
            return self._links(known.unionByName(_linked(self.facts(done))))
        if name == "word_contexts":
            return self._contexts(_placed(old).unionByName(_placed(self.facts(done))), sliced=False)
        if taken_back or name == "sources":
            return None
        if name == "sentences":
            return distinct_sentences(old.select("sentence").unionByName(self.sentences(done).select("sentence")))
        known = old.select(
            "word", "lemma", "language",
            F.col("token_reading").alias("pronunciation"),
            F.lit(done).cast("bigint").alias("seq"),  # before all later commits; the rest of the order decides nothing
            F.lit("").alias("source_id"),
            F.lit(-1).cast("bigint").alias("sentence_idx"),
            F.lit(-1).cast("bigint").alias("first_token_idx"),
        )
        return self._words(known.unionByName(self._occurrences(done)), matches)

    def _by_pair(self, rows: DataFrame, slices: int = 1) -> DataFrame:
        """Rows in ranges of source and word: the one shuffle that both the aggregation and the files of a view need."""
        tasks = estimated_bytes(self._table("facts", FACTS)) // PAIR_BYTES
        if tasks > int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            return rows.repartitionByRange(-(-tasks // slices), *PAIR)
        return rows.repartitionByRange(*PAIR)  # coalesced by AQE

    def _pair_view(self, rows: DataFrame, make: Callable[[DataFrame], DataFrame], sliced: bool = True) -> DataFrame:
        """A view of pairs out of its input rows. Each slice reads the new facts again, which takes time for disk."""
        view = make(self._by_pair(rows))
        _LAID_OUT[view] = PAIR
        if sliced:
            _SLICED[view] = lambda some, slices: make(self._by_pair(rows.where(some), slices))
        return view

    def _slices(self, rows: DataFrame) -> list[DataFrame]:
        """A view of pairs in parts that hold different sources, in their order; a small one is one part."""
        n = min(SLICES, estimated_bytes(self._table("facts", FACTS)) // SLICE_BYTES)
        make = _SLICED.get(rows)
        cuts = self._cuts(n) if make is not None and n > 1 else []
        if not cuts:
            return [rows]
        source = F.col("source_id")
        some = [(source < cuts[0]) | source.isNull()]
        some += [(source >= a) & (source < b) for a, b in zip(cuts, cuts[1:], strict=False)]
        some.append(source >= cuts[-1])
        return [make(one, len(some)) for one in some]

    def _cuts(self, n: int) -> list[str]:
        """Sources at which about ``n`` equal parts of the log begin, after the first; fewer if one source is most of it."""
        known = self._table("progress", PROGRESS).where("source_id IS NOT NULL")
        share = min(1.0, SLICE_SAMPLE / max(1, known.count()))
        some = known.sample(share, seed=1).select("source_id", F.coalesce("text_sentences", F.lit(0)).alias("size"))
        sizes = sorted((r["source_id"], r["size"] + 1) for r in some.collect())
        total, cuts, seen = sum(size for _, size in sizes), [], 0
        for source, size in sizes:
            if seen * n >= total * (len(cuts) + 1) and source != sizes[0][0] and source not in cuts[-1:]:
                cuts.append(source)
            seen += size
        return cuts

    def _links(self, rows: DataFrame) -> DataFrame:
        context = F.lower(F.hex("context_sentence_id"))
        return self._pair_view(rows, lambda ranged: views.word_sources(ranged, contexts=True).select(
            text_id(F.col("word"), F.col("word"), F.col("language")).alias("word_id"),
            "source_id",
            "word",
            context.alias("context_sentence_id"),
            context.alias("example_sentence_id"),
            "occurrence_count",
            "first_seen_at",
            F.lit(0).alias("is_primary"),
            "last_sentence_idx",
            "language",
        ))

    def _contexts(self, rows: DataFrame, sliced: bool = True) -> DataFrame:
        sentence_id = F.lower(F.hex("sentence_id"))
        return self._pair_view(
            rows, lambda ranged: views.top_contexts(ranged).withColumn("sentence_id", sentence_id), sliced)

    def read_view(self, name: str) -> DataFrame:
        version = self._version(name)
        if version is None:
            raise ValueError(f"view {name!r} was never written")
        return self.spark.read.parquet(f"{self.root}/views/{name}/version={version}")


def _write(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    with shuffles_dropped(rows.sparkSession):
        rows.write.mode(mode).options(**FILES).parquet(path)


def _linked(facts: DataFrame) -> DataFrame:
    """Facts as rows that links are made of. Ids of sentences travel as bytes; a word's id is made of it at the end."""
    language, sentence_id = empty_if_null(F.col("language")), F.unhex("sentence_id")
    return facts.select(
        "source_id", "word", language.alias("language"), "n", "sentence_idx", sentence_id.alias("sentence_id"),
        "ingested_at")


def _placed(rows: DataFrame) -> DataFrame:
    """Facts, or contexts, as rows that contexts are made of."""
    return rows.select("source_id", "word", F.unhex("sentence_id").alias("sentence_id"), "sentence_idx")
