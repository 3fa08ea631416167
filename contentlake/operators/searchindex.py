"""A stored search index: inverted lists of names and of file-name trigrams, beside the items and files themselves.

Every list is a run of rows sorted by term (``sources.ranged``): a word of a name with its place, or three letters of file
names with theirs, many places in a row. A phrase is words at neighbouring places, and a piece of a file name is trigrams at fitting places, so the
lists alone settle a query and no text is read again. A dictionary of list lengths lets a search begin with its
rarest needed term: if that has few owners, the other lists are only opened where those owners can be.

The trigrams of a stretch of files are sorted and stored by the task that cuts them, a run of all terms for that stretch: they
are more than all else, and are neither shuffled nor cut a second time to find where to part them.

Items are added by epoch. A later epoch's version of an item replaces the earlier one, files included; list rows carry their
epoch, and hits of versions that were replaced fall out when the items are fetched.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contentlake.functions.paths import path_filename
from contentlake.functions.stems import stem
from contentlake.operators.catalog import Tree, attach_files, match, page_of, parse, plain_tokens, stemmed_tokens, tokens, with_file_count
from contentlake.operators.postings import GRAM, SCHEMA, gram_blocks, unfolded
from contentlake.session import bytes_read, delete_folder, holding, pinned, together
from contentlake.settings import DEFAULTS
from contentlake.sources.ranged import (
    EPOCH, FEW, STRETCH_BYTES, STRETCH_ROWS, WRITING, Ranged, Span, commit, committed, stretches_of, within,
)

BUILDING = WRITING | {"spark.sql.files.maxPartitionBytes": "8m"}  # stored files cut by a task, whose trigrams it sorts

Split = Callable[[str, bool], list[tuple[int, str, bool]] | None]  # a term as (place, word, is_prefix)


def gram_places(text: str) -> list[int]:
    """Places of trigrams that cover a text of three or more letters."""
    return sorted({*range(0, len(text) - GRAM + 1, GRAM), len(text) - GRAM})


def needed(tree: Tree | None) -> list[tuple[str, bool]]:
    """Terms without which nothing matches."""
    if tree is None or tree[0] == "or":
        return []
    if tree[0] == "term":
        return [(tree[1], tree[2])]
    if tree[0] == "not":
        return needed(tree[1])
    return [term for part in tree[1] for term in needed(part)]


def terms(tree: Tree | None) -> list[tuple[str, bool]]:
    """All terms of a query, each once."""
    if tree is None:
        return []
    if tree[0] == "term":
        return [(tree[1], tree[2])]
    parts = tree[1:] if tree[0] == "not" else tree[1]
    return list(dict.fromkeys(term for part in parts for term in terms(part)))


def in_turn(spark: SparkSession, rows_of: Callable[[Span], DataFrame], spans: list[Span]) -> DataFrame:
    """The rows of all spans: of a single one as they are, of several pinned one after another, so that the disk holds what one shuffles."""
    if len(spans) == 1:
        return rows_of(spans[0])
    with holding(spark, WRITING):
        return reduce(DataFrame.union, [pinned(rows_of(span)) for span in spans])


class Lists:
    """Rows (term, owner keys, place), or blocks of such (``postings``), and the number of places of each term."""

    def __init__(self, rows: Ranged, counts: Ranged, keys: list[str], split: Split, blocks: bool = False):
        self.rows, self.counts, self.keys, self.split, self.blocks = rows, counts, [*keys, EPOCH], split, blocks

    def write(self, rows: DataFrame, epoch: int, parts: Sequence[Column] = ()) -> None:
        self.rows.write(rows, epoch, parts, spread=not self.blocks)
        n = F.size("places").cast("bigint") if self.blocks else F.lit(1).cast("bigint")
        self.counts.write(self.rows.epoch(epoch).groupBy("term").agg(F.sum(n).alias("n")), epoch)

    def read(self, words: list[str], prefixes: list[str] = (), owners: list[int] | None = None, span: Span = (None, None)) -> DataFrame:
        """(term, owner keys, place, epoch) of some terms, of all owners, of a few or of a span of their ids."""
        rows = self.rows.read(words, prefixes, owners, span)
        if not self.blocks:
            return rows
        rows = unfolded(rows, EPOCH).filter(within("item_id", span))
        return rows if not owners else rows.filter(F.col("item_id").isin(*owners))

    def few_owners(self, words: list[str]) -> list[int] | None:
        """Owners of the rarest of ``words`` if they are few, else None."""
        if len(words) < 2:
            return None
        known = self.counts.read(words).groupBy("term").agg(F.sum("n").alias("n")).collect()
        sizes = {w: 0 for w in words} | {r["term"]: r["n"] for r in known}
        rarest = min(sizes, key=lambda w: (sizes[w], w))
        if sizes[rarest] > FEW:
            return None
        return sorted(r["item_id"] for r in self.read([rarest]).select("item_id").distinct().collect()) if sizes[rarest] else []

    def hits(self, query: str, spans: Callable[[], list[Span]] = lambda: [(None, None)]) -> DataFrame:
        """Owners of a query's matches, by their keys, each once; of many owners, those of each span are found and pinned in turn."""
        tree = parse(query)
        split = {term: self.split(*term) for term in terms(tree)}
        leaves = {term: k for k, term in enumerate(t for t in split if split[t])}
        uses = [(leaves[t], *use) for t in leaves for use in split[t]]
        words = sorted({w for _, _, w, is_prefix in uses if not is_prefix})
        prefixes = sorted({w for _, _, w, is_prefix in uses if is_prefix})
        must = sorted({w for t in needed(tree) for _, w, is_prefix in split[t] or () if not is_prefix})
        owners = self.few_owners(must) if len(words) + len(prefixes) > 1 else None
        sizes = F.array(*[F.lit(len(split[t])) for t in leaves]) if leaves else F.array().cast("array<int>")
        marks = [
            F.when(
                F.startswith("term", F.lit(w)) if is_prefix else F.col("term") == F.lit(w),
                F.struct(F.lit(leaf).alias("leaf"), (F.col("place") - F.lit(at)).alias("start")),
            )
            for leaf, at, w, is_prefix in uses
        ]
        if not marks:
            return self.read(words, prefixes, owners).filter("false").select(*self.keys)

        def leaf(text: str, is_prefix: bool) -> Column | None:
            number = leaves.get((text, is_prefix))
            return None if number is None else F.array_contains("leaves", number)

        def found(span: Span) -> DataFrame:
            rows = self.read(words, prefixes, owners, span)
            used = rows.withColumn("use", F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())))
            # One shuffle by owner serves all that follows; an owner has as many rows as its text has words or letters.
            used = used.select(*self.keys, "use.leaf", "use.start").repartition("item_id")
            whole = used.groupBy(*self.keys, "leaf", "start").agg(F.count(F.lit(1)).alias("n"))
            whole = whole.filter(F.col("n") == F.get(sizes, F.col("leaf")))
            owned = whole.groupBy(*self.keys).agg(F.collect_set("leaf").alias("leaves"))
            return owned.filter(match(query, leaf)).select(*self.keys)

        return in_turn(self.rows.spark, found, [(None, None)] if owners is not None else spans())


class SearchIndex:
    """items(item_id, name, ...) and item_files(item_id, file_index, path, ...) with their lists in one folder."""

    def __init__(self, spark: SparkSession, path: str, note: dict):
        self.spark, self.path, self.note = spark, path, note
        self.stemming, files = note["stemming"], note["files"]

        def table(name: str, schema: StructType | str, *columns: str, reach: str | None = None, gaps: Sequence[str] = ()) -> Ranged:
            schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
            return Ranged(spark, path, name, schema, columns, files, reach, gaps)

        self.items = table("items", StructType.fromJson(note["items"]), "item_id")
        self.item_files = table("item_files", StructType.fromJson(note["item_files"]), "item_id", "file_index")
        counts = "term string, n long"
        self.names = Lists(table("names", "term string, item_id long, place int", "term", "item_id"), table("name_terms", counts, "term"), ["item_id"], self.words)
        self.grams = Lists(
            table("grams", SCHEMA, "term", "item_id", reach="last_id", gaps=["item_ids.list.element"]), table("gram_terms", counts, "term"), ["item_id", "file_index"], self.pieces, True,
        )

    @classmethod
    def create(cls, spark: SparkSession, path: str, items: DataFrame, files: DataFrame, stemming: bool = True, parts: int | None = None) -> SearchIndex:
        """An empty index for tables like these. What its readers must know (stemming, schemas) is stored with it; ``parts``
        fixes the number of files of an epoch's tables, which otherwise follows their size."""
        note = {"stemming": stemming, "files": parts, "items": items.schema.jsonValue(), "item_files": files.schema.jsonValue()}
        spark.createDataFrame([(json.dumps(note),)], "note string").coalesce(1).write.text(f"{path}/note")
        return cls(spark, path, note)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SearchIndex:
        return cls(spark, path, json.loads(spark.read.text(f"{path}/note").first()[0]))

    def words(self, text: str, is_prefix: bool) -> list[tuple[int, str, bool]] | None:
        found = [stem(w) if self.stemming else w for w in plain_tokens(text)]
        return [(k, w, is_prefix and k == len(found) - 1) for k, w in enumerate(found)] or None

    @staticmethod
    def pieces(text: str, is_prefix: bool) -> list[tuple[int, str, bool]] | None:
        low = text.lower()
        return [(k, low[k : k + GRAM], False) for k in gram_places(low)] if len(low) >= GRAM else None

    def trigrams(self, epoch: int) -> DataFrame:
        """Blocks of an epoch's stored files: these lie in the order of items, so a block spans few of them."""
        return gram_blocks(self.item_files.epoch(epoch).select("item_id", "file_index", F.lower(path_filename(F.col("path"))).alias("name")))

    def add(self, items: DataFrame, files: DataFrame, epoch: int) -> None:
        """Add a batch of items with all their files. An item's later epoch replaces its earlier one; a repeated epoch replaces itself."""
        with holding(self.spark, BUILDING):
            self.items.write(items, epoch)
            spans = self.items.spans(stretches_of(bytes_read(files), STRETCH_BYTES), epoch)
            self.item_files.write(files, epoch, [within("item_id", span) for span in spans])
            words = stemmed_tokens(F.col("name")) if self.stemming else tokens(F.col("name"))
            words = self.items.epoch(epoch).select("item_id", F.posexplode(words).alias("place", "term"))
            together(lambda: self.names.write(words, epoch), lambda: self.grams.write(self.trigrams(epoch), epoch))
            commit(self.spark, self.path, epoch)

    def spans(self) -> list[Span]:
        """Stretches of items to take in turn."""
        rows = self.item_files.ranges().union(self.items.ranges()).agg(F.sum("rows")).first()[0]
        return self.items.spans(stretches_of(rows or 0, STRETCH_ROWS))

    def _fetched(self, table: Ranged, hits: DataFrame, few: list[int] | None, span: Span = (None, None)) -> DataFrame:
        """Rows of the hits' own version; ``few``: their ids, if they can be named; else of a span of items."""
        rows = table.all().filter(within("item_id", span)) if few is None else table.read(few)
        return rows.join(hits.filter(within("item_id", span)), [c for c in hits.columns if c in ("item_id", "file_index", EPOCH)], "left_semi")

    def _current(self, hits: DataFrame) -> tuple[DataFrame, list[int] | None]:
        """Hits of versions that were not replaced, and their ids if they are few. The narrow hits are pinned once."""
        hits = pinned(hits)
        ids = [r["item_id"] for r in hits.select("item_id").distinct().limit(FEW + 1).collect()]
        few = sorted(ids) if len(ids) <= FEW else None
        if committed(self.spark, self.path).count() == 1:
            return hits, few
        known = self.items.all() if few is None else self.items.read(few)
        latest = known.select("item_id", EPOCH).groupBy("item_id").agg(F.max(EPOCH).alias(EPOCH))
        return hits.join(latest, ["item_id", EPOCH], "left_semi"), few

    def item_hits(self, query: str) -> DataFrame:
        """(item_id, epoch) of items hit by name or by one of their file names."""
        owners = self.grams.hits(query, self.spans).select("item_id", EPOCH)
        return self.names.hits(query, self.spans).union(owners).distinct()

    def search_names(self, query: str) -> DataFrame:
        """The rows of ``catalog.search_names`` from the lists."""
        return self._fetched(self.items, *self._current(self.names.hits(query, self.spans))).drop(EPOCH)

    def search_files(self, query: str) -> DataFrame:
        """The rows of ``catalog.search_files`` from the lists."""
        hits, few = self._current(self.grams.hits(query, self.spans))
        if few is not None:
            return self._fetched(self.item_files, hits, few).drop(EPOCH)

        def rows(span: Span) -> DataFrame:
            return self._fetched(self.item_files, hits, None, span).drop(EPOCH)

        return in_turn(self.spark, rows, self.spans())

    def search(self, query: str) -> DataFrame:
        """The rows of ``catalog.search`` from the lists."""
        return self._fetched(self.items, *self._current(self.item_hits(query))).drop(EPOCH)

    def search_count(self, query: str) -> DataFrame:
        return self._current(self.item_hits(query))[0].agg(F.count_distinct("item_id").alias("total_count"))

    def result_page(self, query: str, page: int = 1, size: int = DEFAULTS.page_size) -> DataFrame:
        """A ranked page with file counts and first files; only the files of its items are opened."""
        top = self.search(query)
        top = self.spark.createDataFrame(page_of(top, page, size).toArrow(), top.schema)
        ids = [r["item_id"] for r in top.select("item_id").collect()]
        version = self.items.read(ids).groupBy("item_id").agg(F.max(EPOCH).alias(EPOCH))
        own = self.item_files.read(ids).join(version, ["item_id", EPOCH], "left_semi").drop(EPOCH)
        return attach_files(with_file_count(top, own), own)

    def compact(self, target: str, keep: bool = True) -> SearchIndex:
        """The current versions as the only epoch of a new folder, a stretch of items after another. Words are merged without being
        split or stemmed again; trigrams are cut from the current files, which are far fewer rows than their places. Unless it is
        to ``keep``, this index is deleted once the new folder has its items, files and words, so that not all is stored twice."""
        new = SearchIndex.create(self.spark, target, self.spark.createDataFrame([], self.items.schema), self.spark.createDataFrame([], self.item_files.schema), self.stemming, self.note["files"])
        latest = self.items.all().select("item_id", EPOCH).groupBy("item_id").agg(F.max(EPOCH).alias(EPOCH))
        tables = [(self.items, new.items), (self.item_files, new.item_files), (self.names.rows, new.names)]
        with holding(self.spark, BUILDING):
            parts = [within("item_id", span) for span in self.spans()]
            for old, own in tables:
                own.write(old.all().join(latest, ["item_id", EPOCH], "left_semi"), 0, parts)
            if not keep:
                delete_folder(self.spark, self.path)
            new.grams.write(new.trigrams(0), 0)
            commit(self.spark, target, 0)
        return new
