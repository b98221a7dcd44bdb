"""Quad stores: sorted Parquet data with optional indexes, a tail of additions and tombstones, all of them immutable."""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import terms
from .operators import layouts
from .plans.pattern import Pattern, access_path, conjunction, tail_needs_compaction
from .schema import QUAD, QUADS, TERMS, options, stored
from .storage import fresh, numbered_files, ranged, read_json, write_json, written

#: Keys, rows or row ids up to which a look-up reads them to the driver and pushes them to the scan; ISIN of them as values.
FEW, ISIN = 4096, 64
#: Quads that an ingest from Python packs at once, and terms whose codes a store remembers.
CHUNK, PROBES = 65_536, 256
#: Deletions that a store keeps as patterns; further ones are kept as row ids.
GONE = 32
_ORDERS = {"posg": ["p", "o", "s", "g"], "ospg": ["o", "s", "p", "g"]}


class StoreError(Exception):
    """What can't be done with this store."""


class _Shared:
    """What a store and its views have in common: codes that were looked up, and tables if they are held in memory."""

    def __init__(self, resident_terms: int | None = None, eager: bool = False):
        self.resident_terms = layouts.MOST_BROADCAST_TERMS if resident_terms is None else resident_terms
        self.eager, self.codes, self.tables = eager, {}, {}


def _local(spark: SparkSession, column: str, values: list) -> DataFrame:
    return spark.createDataFrame(pa.table({column: pa.array(values, pa.int64() if values and isinstance(values[0], int) else pa.string())}))


def _among(rows: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column has one of a few values, which the scan is told, if they are many by the range that they span."""
    if len(values) <= ISIN:
        return rows.where(F.col(column).isin(values) if values else F.lit(False))
    keys = F.broadcast(_local(rows.sparkSession, "_k", values))  # FEW at most
    return rows.where(F.col(column).between(min(values), max(values))).join(keys, F.col(column) == F.col("_k"), "left_semi")


def _narrowed(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose column is among the keys, distinct in their one column."""
    some = [r[0] for r in keys.limit(FEW + 1).collect()]
    if len(some) <= FEW:
        return _among(rows, column, some)
    keys = keys.toDF("_k")
    low, high = keys.agg(F.min("_k"), F.max("_k")).first()
    return rows.where(F.col(column).between(low, high)).join(keys, F.col(column) == F.col("_k"), "left_semi")


class QuadStore:
    """A store, or a view of one that patterns have narrowed. Every change returns a new store and leaves this one."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict, patterns: tuple[Pattern, ...] = (), shared: _Shared | None = None):
        self.spark, self.path, self.manifest, self.patterns, self._shared = spark, path, manifest, patterns, shared or _Shared()

    # building and opening

    @classmethod
    def build(cls, quads: DataFrame, path: str | None = None, layout: str = "default", indexes: Iterable[str] = (), builder: str = "sorted_stream") -> QuadStore:
        """Stores quads, duplicates included, in a new folder. Only the unsorted builder keeps the order of arrival."""
        spark = quads.sparkSession
        layout, chosen, builder = options(layout, indexes, builder)
        path = (path or fresh(spark, "store")).rstrip("/")
        return cls(spark, path, cls._write(quads, path, layout, chosen, builder, 0))._committed()

    @classmethod
    def empty(cls, spark: SparkSession, path: str | None = None, **kw) -> QuadStore:
        return cls.build(spark.createDataFrame([], QUADS), path, **kw)

    @classmethod
    def open(cls, spark: SparkSession, path: str, resident_terms: int | None = None) -> QuadStore:
        """The latest version in a folder. Reads the manifest alone; FileNotFoundError if there is none. A dictionary of
        up to resident_terms terms is broadcast to where it is needed, a larger one is joined; 0 never broadcasts it."""
        path = path.rstrip("/")
        found = numbered_files(spark, path, "manifest-")
        if not found:
            raise FileNotFoundError(f"{path}: no manifest")
        return cls(spark, path, read_json(spark, found[max(found)]), shared=_Shared(resident_terms))

    @classmethod
    def load(cls, spark: SparkSession, path: str, resident_terms: int | None = None) -> QuadStore:
        """Like open(), with the tables held in the executors' memory from their first use on; unload() gives it back.
        What doesn't fit stays on disk."""
        store = cls.open(spark, path, resident_terms)
        store._shared.eager = True
        store._read("base").count()
        return store

    def unload(self) -> None:
        for df in self._shared.tables.values():
            df.unpersist()
        self._shared.tables.clear()
        self._shared.eager = False

    @classmethod
    def ingest(cls, spark: SparkSession, quads: Iterable[tuple], path: str | None = None, chunk: int = CHUNK, **kw) -> QuadStore:
        """Stores quads of a Python iterable, duplicates included, of which one chunk at a time is on the driver."""
        staged, quads = fresh(spark, "packed"), iter(quads)
        spark.createDataFrame([], QUADS).write.parquet(staged)
        while part := list(islice(quads, chunk)):
            _packed(spark, part).write.mode("append").parquet(staged)
        return cls.build(spark.read.schema(QUADS).parquet(staged), path, **kw)

    @classmethod
    def from_table(cls, table: DataFrame | pa.Table, dictionary: DataFrame | pa.Table | None = None, spark: SparkSession | None = None, path: str | None = None, **kw) -> QuadStore:
        """A store of a table whose columns tell its layout: o_kind is there in typed_object, s, p, o and g are integers
        in dictionary, which needs the dictionary (code, term) too, and text, plain or Arrow-encoded, in default. The
        layout can be given to store it in another. Further columns are left out. Terms are taken as they are."""
        spark = spark or getattr(table, "sparkSession", None) or SparkSession.active()
        frame = lambda t: t if isinstance(t, DataFrame) else spark.createDataFrame(_unencoded(t))
        df = frame(table)
        types = dict(df.dtypes)
        missing = [c for c in ("s", "p", "g") if c not in types]
        if missing or ("o" not in types and "o_kind" not in types):
            raise ValueError(f"no quads: columns {', '.join(df.columns)}")
        if "o_kind" in types:
            found, quads = "typed_object", layouts.plain_objects(df.select("s", "p", "o_kind", "o_value", "o_datatype", "o_lang", "g"))
        elif types["s"] in ("tinyint", "smallint", "int", "bigint"):
            if dictionary is None:
                raise ValueError("codes without a dictionary")
            words = frame(dictionary).select(F.col("code").cast("long").alias("code"), "term")
            found, n = "dictionary", words.count()
            quads = written(layouts.decoded(df.select(*(F.col(c).cast("long").alias(c) for c in QUAD)), {c: (words, n) for c in QUAD}), fresh(spark, "decoded"))
        else:
            found, quads = "default", df
        return cls.build(quads.select(*QUAD), path, **({"layout": found} | kw))

    # bytes

    def ready(self) -> tuple[pa.Table, pa.Table | None]:
        """The quads that match, in this layout, and the dictionary of just these quads, as Arrow tables on the driver,
        which must be able to hold them."""
        quads = self.quads()
        if self.layout == "typed_object":
            return layouts.typed_objects(quads).toArrow(), None
        table = quads.toArrow()
        if self.layout == "default":
            return table, None
        table = table.cast(pa.schema([(c, pa.large_string()) for c in QUAD]))
        terms_ = pc.unique(pa.chunked_array([pc.unique(table.column(c)) for c in QUAD], pa.large_string()))
        terms_ = terms_.take(pc.sort_indices(terms_))  # by bytes
        codes = pa.table({c: pc.index_in(table.column(c), terms_).cast(pa.int64()) for c in QUAD})
        return codes, pa.table({"code": pa.array(np.arange(len(terms_)), pa.int64()), "term": terms_})

    def to_bytes(self, chunk: int = CHUNK) -> bytes:
        """Arrow IPC: a stream of the quads, a message for each chunk, and behind it one of the dictionary if there is
        one. The schema's metadata has the build options, so the bytes describe themselves. The driver must be able to
        hold them; write_bytes() does without it."""
        about = {"layout": self.layout, "indexes": ",".join(self.indexes), "builder": self.manifest["builder"]}
        sink = pa.BufferOutputStream()
        for table in self.ready():
            if table is not None:
                with pa.ipc.new_stream(sink, table.schema.with_metadata(about)) as out:
                    out.write_table(table.replace_schema_metadata(about), max_chunksize=chunk)
        return sink.getvalue().to_pybytes()

    def write_bytes(self, path: str | None = None) -> str:
        """Arrow IPC of any size, in a folder: a table (part, bytes) whose rows are streams of a batch of quads or of the
        dictionary, written and read by the tasks, and one without rows that has the schema and the build options."""
        plain = not (self.is_view or self.manifest["tail"] or self._fewer)
        store = self if plain else self.owned(fresh(self.spark, "owned"))
        path = path or fresh(self.spark, "bytes")
        quads = store.codes() if self.layout == "dictionary" else store.quads()
        parts = {"quads": layouts.typed_objects(quads) if self.layout == "typed_object" else quads} | ({"dictionary": store.terms()} if self.layout == "dictionary" else {})
        about = {"layout": self.layout, "indexes": ",".join(self.indexes), "builder": self.manifest["builder"]}
        first = _stream(parts["quads"].limit(0).toArrow().replace_schema_metadata(about))
        self.spark.createDataFrame([("about", first)], _BYTES).write.parquet(path)
        for part, rows in parts.items():
            rows.mapInArrow(_streams(part), _BYTES).write.mode("append").parquet(path)
        return path

    @classmethod
    def read_bytes(cls, spark: SparkSession, source: str, path: str | None = None, **kw) -> QuadStore:
        """A store of what write_bytes() wrote; options are those in the bytes unless given."""
        streams = spark.read.schema(_BYTES).parquet(source)
        first = pa.ipc.open_stream(streams.where(F.col("part") == "about").first()["bytes"]).read_all()
        rows = lambda part, schema: written(streams.where(F.col("part") == part).select("bytes").mapInArrow(_read_streams, schema), fresh(spark, part))
        told = _told(first)
        words = rows("dictionary", stored("dictionary", "dict")) if told["layout"] == "dictionary" else None
        return cls.from_table(rows("quads", spark.createDataFrame(first).schema), words, spark, path, **(told | kw))

    @classmethod
    def from_bytes(cls, spark: SparkSession, data: bytes, path: str | None = None, **kw) -> QuadStore:
        """A store of what to_bytes() wrote, or of any Arrow IPC stream of quads. All messages of it are read. Options
        are those in the bytes unless given."""
        source, tables = pa.BufferReader(data), []
        while source.tell() < len(data):
            tables.append(pa.ipc.open_stream(source).read_all())
        if not tables:
            raise ValueError("no Arrow stream")
        return cls.from_table(tables[0], tables[1] if len(tables) > 1 else None, spark, path, **(_told(tables[0]) | kw))

    @staticmethod
    def _blank(path: str, layout: str, indexes: tuple[str, ...], builder: str, version: int) -> dict:
        at = f"{path}/v{version}-{uuid.uuid4().hex[:8]}"
        return {"version": version, "layout": layout, "indexes": list(indexes), "builder": builder, "base": f"{at}/base", "at": at, "tail": [], "tombs": [], "gone": [], "tail_rows": 0, "terms": 0}

    @classmethod
    def _write(cls, quads: DataFrame, path: str, layout: str, indexes: tuple[str, ...], builder: str, version: int, n: int | None = None) -> dict:
        quads = quads.select(*(F.col(c).cast("string").alias(c) for c in QUAD))
        spark, manifest = quads.sparkSession, cls._blank(path, layout, indexes, builder, version)
        at = manifest["at"]
        if layout == "dictionary":  # a pass for their number and for the predicates and graphs
            pairs = written(quads.groupBy("p", "g").agg(F.count("*").alias("n")), fresh(spark, "pairs"))
            n = pairs.agg(F.sum("n")).first()[0] or 0
        n = quads.count() if n is None else n
        hot = layouts.hot_values(quads, "so" if layout == "dictionary" else "s", n)
        rows, tie = (layouts.tied(quads), ["_tie"]) if hot["s"] else (quads, [])  # else no quad is there very often
        if layout == "dictionary":
            words = written(layouts.dictionary(quads, pairs), f"{at}/dict")  # in the order of its ranges as it is
            manifest["terms"] = words.count()
            few = {}
            for c in "pg":  # predicates and graphs are few as a rule, and then encoded and decoded without the others
                few[c] = written(layouts.of_position(pairs, words, "term", c).select("code", "term"), f"{at}/dict_{c}")
                manifest[f"terms_{c}"] = few[c].count()
            rows = layouts.encoded(rows, words, manifest["terms"], rows=n, few=few, hot=hot)
        return cls._laid(rows, manifest, n, tie)

    @staticmethod
    def _laid(rows: DataFrame, manifest: dict, n: int, tie: list[str]) -> dict:
        """Writes the base, of terms or codes, and the indexes."""
        spark, at, layout, indexes = rows.sparkSession, manifest["at"], manifest["layout"], manifest["indexes"]
        if manifest["builder"] != "unsorted_stream":  # the tie spreads equal quads over ranges
            rows = ranged(rows, n, *QUAD, *tie)
        rows = rows.drop("_tie").withColumn("rid", F.monotonically_increasing_id())
        (layouts.typed_objects(rows) if layout == "typed_object" else rows).write.parquet(f"{at}/base")
        base = spark.read.schema(stored(layout, "base")).parquet(f"{at}/base")
        manifest["base_rows"] = base.count()
        flat = layouts.plain_objects(base) if layout == "typed_object" else base
        if "by_copy" in indexes:
            for name, order in _ORDERS.items():
                ranged(flat, n, *order, "rid").write.parquet(f"{at}/{name}")
        if "by_reference" in indexes:
            for c in "op":
                pairs = flat.select(F.col(c).alias("val"), "rid")
                ranged(pairs, n, "val", "rid").write.parquet(f"{at}/ref_{c}")
        return manifest

    def _committed(self) -> QuadStore:
        """Writes the manifest under its version's number; another writer of the same version makes it fail."""
        write_json(self.spark, f"{self.path}/manifest-{self.manifest['version']}.json", self.manifest)
        return self

    # what it is

    @property
    def layout(self) -> str:
        return self.manifest["layout"]

    @property
    def indexes(self) -> tuple[str, ...]:
        return tuple(self.manifest["indexes"])

    @property
    def is_view(self) -> bool:
        return any(p.bound for p in self.patterns)

    @property
    def _fewer(self) -> bool:
        """Whether rows of the base are deleted."""
        return bool(self.manifest["tombs"] or self.manifest.get("gone"))

    def tail_len(self) -> int:
        return self.manifest["tail_rows"]

    def _read(self, name: str) -> DataFrame:
        at = f"{self.manifest['at']}/{name}"
        if at in self._shared.tables:
            return self._shared.tables[at]
        df = self.spark.read.schema(stored(self.layout, name)).parquet(at)
        if self._shared.eager:
            df = self._shared.tables[at] = df.persist()
        return df

    def terms(self) -> DataFrame | None:
        """(code, term) of this version, or None without a dictionary. Terms of the tail have no code."""
        return self._read("dict") if self.layout == "dictionary" else None

    def encode_term(self, term: str) -> int | None:
        return self._probed([term if term == "" else terms.term(term)])[0] if self.layout == "dictionary" else None

    def _probed(self, wanted: list[str]) -> list[int | None]:
        """Codes of terms, None for those without one. The last ones are remembered, for a dictionary never changes."""
        codes, at = self._shared.codes, self.manifest["at"]
        unknown = sorted({t for t in wanted if (at, t) not in codes})
        if unknown:
            found = {r["term"]: r["code"] for r in _among(self.terms(), "term", unknown).collect()}
            while len(codes) + len(unknown) > PROBES and codes:
                del codes[next(iter(codes))]
            codes.update({(at, t): found.get(t) for t in unknown})
        return [codes[at, t] for t in wanted]

    def decode_code(self, code: int) -> str | None:
        words = self.terms()
        row = words and words.where(F.col("code") == code).first()
        return row["term"] if row else None

    # matching

    def match(self, s=None, p=None, o=None, g=None) -> QuadStore:
        """A lazy view of the quads with these terms; None is open, DEFAULT_GRAPH the default graph. On a view it narrows
        further. A term that can't be in its position is a ValueError."""
        return QuadStore(self.spark, self.path, self.manifest, (*self.patterns, Pattern.of(s, p, o, g)), self._shared)

    def _merged(self) -> Pattern | None:
        """All patterns as one; None if they contradict each other."""
        out: dict[str, str] = {}
        for pattern in self.patterns:
            for c, x in pattern.bound.items():
                if out.setdefault(c, x) != x:
                    return None
        return Pattern(**out)

    def access_path(self) -> str:
        merged = self._merged()
        return access_path(merged, self.indexes) if merged else "base"

    def _base(self, only: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """Live rows of the base that match: s, p, o, g (codes in a dictionary) and rid. `only` may narrow what is read.

        Row ids of an index by reference are read first. If they are few, the base is scanned for them, which its sorted
        row ids let it do in few places; if not, it is scanned for the terms, as a join would only add to that."""
        pattern = self._merged()
        path = self.access_path()
        codes = self._coded(pattern.bound if pattern else {})
        never = pattern is None or -1 in codes.values()
        equal = conjunction([F.col(c) == F.lit(x) for c, x in codes.items()])
        if path in _ORDERS:
            rows = self._read(path).where(equal)
        else:
            rows = only(self._read("base"))
            if path.startswith("ref_") and not never:
                rids = [r[0] for r in self._read(path).where(F.col("val") == F.lit(codes[path[-1]])).select("rid").limit(FEW + 1).collect()]
                if len(rids) <= FEW:
                    rows = _among(rows, "rid", rids)
            if self.layout == "typed_object":
                rows = layouts.plain_objects(rows.where(pattern.typed_condition() if pattern else F.lit(False)))
            else:
                rows = rows.where(equal)
        if never:
            rows = rows.where(F.lit(False))
        for gone in self.manifest.get("gone", []):
            rows = rows.where(~self._equal(gone))
        if self.manifest["tombs"]:
            rows = rows.join(self.spark.read.schema("rid bigint").parquet(*self.manifest["tombs"]), "rid", "left_anti")
        return rows.select(*QUAD, "rid")

    def _coded(self, bound: dict[str, str]) -> dict[str, object]:
        """Bound terms as the base holds them, -1 for those without a code."""
        if self.layout != "dictionary" or not bound:
            return dict(bound)
        return {c: -1 if x is None else x for c, x in zip(bound, self._probed(list(bound.values())))}  # four at most

    def _equal(self, bound: dict[str, str]) -> Column:
        return conjunction([F.col(c) == F.lit(x) for c, x in self._coded(bound).items()])

    def _tail(self) -> DataFrame | None:
        if not self.manifest["tail"]:
            return None
        pattern = self._merged()
        return self.spark.read.schema(QUADS).parquet(*self.manifest["tail"]).where(pattern.condition() if pattern else F.lit(False))

    # reading

    def quads(self) -> DataFrame:
        """(s, p, o, g) as terms; the order is no contract. Lazy, but for a view of a dictionary's store: this reads the
        codes of up to FEW matching rows and, if these are all, their terms alone, instead of joining the dictionary."""
        base = self._base().select(*QUAD)
        if self.layout == "dictionary":
            known = (self._merged() or Pattern()).bound  # needs no look-up
            open_ = [c for c in QUAD if c not in known]
            some = base.select(*open_).limit(FEW + 1).collect() if known and open_ else None
            if some is not None and len(some) <= FEW:
                codes = sorted({x for r in some for x in r})
                words = {r["code"]: r["term"] for r in _among(self.terms(), "code", codes).collect()} if codes else {}
                base = self.spark.createDataFrame(pa.table({c: pa.array([known[c]] * len(some) if c in known else [words[r[c]] for r in some], pa.string()) for c in QUAD}))
            else:
                sides = {c: (self._read(f"dict_{c}"), self.manifest[f"terms_{c}"]) if c in "pg" else (self.terms(), self.manifest["terms"]) for c in open_}
                base = layouts.decoded(base, sides, self._shared.resident_terms, None if known or self._fewer else self.manifest["base_rows"])
                base = base.withColumns({c: F.lit(x) for c, x in known.items()}).select(*QUAD)
        tail = self._tail()
        return base if tail is None else base.unionByName(tail)

    def __iter__(self) -> Iterator[tuple[str, str, str, str]]:
        """The quads one by one, a partition at a time on the driver."""
        return (tuple(r) for r in self.quads().toLocalIterator(prefetchPartitions=True))

    def triples(self) -> DataFrame:
        """Without graphs; a triple of two graphs comes twice."""
        return self.quads().select("s", "p", "o")

    def codes(self) -> DataFrame | None:
        """(s, p, o, g) as codes, without the dictionary; None in other layouts or with a tail, whose terms have none."""
        return None if self.layout != "dictionary" or self.manifest["tail"] else self._base().select(*QUAD)

    def code_column(self, column: str) -> np.ndarray | None:
        """The codes of one position, on the driver, as Arrow delivers them; None where codes() is."""
        codes = self.codes()
        return None if codes is None else codes.select(column).toArrow().column(0).combine_chunks().to_numpy(zero_copy_only=False)

    def compact_result(self) -> tuple[DataFrame, DataFrame]:
        """The distinct terms of the matching triples as (id, term), and the triples as ids."""
        triples = written(self.triples(), fresh(self.spark, "triples"))
        words = layouts.dense_ranks(triples.select(F.explode(F.array("s", "p", "o")).alias("term")).distinct(), ["term"], "id", fresh(self.spark, "compact")).select("id", "term")
        return words, layouts.encoded(triples.withColumn("g", F.col("s")), words.withColumnRenamed("id", "code"), self.manifest["terms"] or layouts.MOST_BROADCAST_TERMS + 1).select("s", "p", "o")

    def size(self) -> int:
        tail = self._tail()
        if not self.is_view and not self._fewer:
            return self.manifest["base_rows"] + self.manifest["tail_rows"]
        return self._base().count() + (tail.count() if tail is not None else 0)

    def __len__(self) -> int:
        return self.size()

    def contains(self, s: str, p: str, o: str, g: str = "") -> bool:
        return not self.match(s, p, o, g)._matches_nothing()

    def _matches_nothing(self) -> bool:
        tail = self._tail()
        return self._base().isEmpty() and (tail is None or tail.isEmpty())

    # changes

    def _owner(self, what: str) -> None:
        if self.is_view:
            raise StoreError(f"{what}: this is a view of a store; owned() makes a store of it")

    def _next(self, **changes) -> QuadStore:
        return QuadStore(self.spark, self.path, self.manifest | {"version": self.manifest["version"] + 1} | changes, (), self._shared)

    def _part(self, kind: str) -> str:
        return f"{self.path}/{kind}-{uuid.uuid4().hex}"

    def add(self, quads: DataFrame | pa.Table | Iterable[tuple]) -> QuadStore:
        """With the quads that aren't in the store yet, each once. Of the base only what has one of the new subjects is
        read; it stays as it is, and a large tail is compacted. An Arrow table's terms are taken as they are, like a
        DataFrame's."""
        self._owner("add")
        if isinstance(quads, pa.Table):
            quads = self.spark.createDataFrame(_unencoded(quads))
        elif not isinstance(quads, DataFrame):
            quads = _packed(self.spark, list(quads))
        part, tail = self._part("tail"), self._tail()
        new = quads.select(*QUAD).distinct()
        if self.manifest["base_rows"] or tail is not None:  # an empty store has none of them
            new = written(new, fresh(self.spark, "new"))
            new = new.join(self._present(new), list(QUAD), "left_anti") if self.manifest["base_rows"] else new
            new = new if tail is None else new.join(tail, list(QUAD), "left_anti")
        new.write.parquet(part)
        n = self.spark.read.schema(QUADS).parquet(part).count()
        if not n:
            return self
        out = self._next(tail=[*self.manifest["tail"], part], tail_rows=self.manifest["tail_rows"] + n)
        if tail_needs_compaction(out.tail_len(), out.manifest["base_rows"]):
            return out._compacted(self.indexes)
        return out._committed()

    def _present(self, new: DataFrame) -> DataFrame:
        """Those of the quads that the live base has. It is sorted by subject, so a few subjects are in few places."""
        if self.layout != "dictionary":
            return self._base(lambda rows: _narrowed(rows, "s", new.select("s").distinct())).select(*QUAD)
        terms_ = new.select(F.explode(F.array(*QUAD)).alias("term")).distinct()
        words = written(_narrowed(self.terms(), "term", terms_), fresh(self.spark, "words"))
        known = new
        for c in QUAD:  # a term without a code is in no quad of the base
            known = known.join(words.select(F.col("term").alias(c), F.col("code").alias(f"{c}_")), c)
        known = written(known.select(*QUAD, *(f"{c}_" for c in QUAD)), fresh(self.spark, "known"))
        base = self._base(lambda rows: _narrowed(rows, "s", known.select("s_").distinct())).select(*(F.col(c).alias(f"{c}_") for c in QUAD))
        return known.join(base, [f"{c}_" for c in QUAD], "left_semi").select(*QUAD)

    def delete(self, s=None, p=None, o=None, g=None) -> QuadStore:
        """Without all quads that match, duplicates included."""
        self._owner("delete")
        view = self.match(s, p, o, g)
        changes: dict = {}
        bound, old = view._merged().bound, self.manifest.get("gone", [])
        if len(old) < GONE:  # what is gone is told by its terms, and no row needs to be looked up by its id
            if not view._base().isEmpty():
                changes["gone"] = [*old, bound]
        else:
            part = self._part("tombs")
            view._base().select("rid").write.parquet(part)
            if not self.spark.read.parquet(part).isEmpty():
                changes["tombs"] = [*self.manifest["tombs"], part]
        gone = view._tail()
        if gone is not None and not gone.isEmpty():
            rest = self._part("tail")
            self.spark.read.schema(QUADS).parquet(*self.manifest["tail"]).where(~view._merged().condition()).write.parquet(rest)
            changes |= {"tail": [rest], "tail_rows": self.spark.read.parquet(rest).count()}
        return self._next(**changes)._committed() if changes else self

    def delete_quad(self, s: str, p: str, o: str, g: str = "") -> QuadStore:
        return self.delete(s, p, o, g)

    def _compacted(self, indexes: Iterable[str]) -> QuadStore:
        layout, chosen, builder = options(self.layout, indexes, self.manifest["builder"])
        version = self.manifest["version"] + 1
        manifest = self._recoded(self._blank(self.path, layout, chosen, builder, version)) if self.layout == "dictionary" else None
        if manifest is None:
            quads = self.quads()
            if self.layout == "dictionary":  # several passes are made over it
                quads = written(quads, fresh(self.spark, "folded"))
            manifest = self._write(quads, self.path, layout, chosen, builder, version, None if self.layout == "dictionary" else self.size())
        return QuadStore(self.spark, self.path, manifest, (), self._shared)._committed()

    def _recoded(self, manifest: dict) -> dict | None:
        """Base and tail as a new base by codes alone, without decoding the base, where few terms come and go; else None.

        The new dictionary is the old one without the terms that no quad has any more, and with the tail's new terms, so
        a code moves by how many of either lie before it, which a task finds in the sorted lists of them."""
        spark, words, live, tail, at = self.spark, self.terms(), self._base().select(*QUAD), self._tail(), manifest["at"]
        known, added = spark.createDataFrame([], TERMS), []
        if tail is not None:
            own = written(tail.select(F.explode(F.array(*QUAD)).alias("term")).distinct(), fresh(spark, "own"))
            known = written(_narrowed(words, "term", own), fresh(spark, "known"))
            added = sorted(r[0] for r in own.join(known, "term", "left_anti").limit(FEW + 1).collect())
            if len(added) > FEW:
                return None
        pairs = written(live.groupBy("p", "g").agg(F.count("*").alias("n")), fresh(spark, "pairs"))
        n = (pairs.agg(F.sum("n")).first()[0] or 0) + self.manifest["tail_rows"]
        removed = np.zeros(0, np.int64)
        if self._fewer:  # else all terms of the base are in use
            used = live.select(F.explode(F.array("s", "o"))).union(pairs.select(F.explode(F.array("p", "g")))).union(known.select("code"))
            marks = words.select("code", F.lit(0).alias("used")).union(used.select("*", F.lit(1)))
            unused = marks.groupBy("code").agg(F.max("used").alias("used")).where("used = 0").select("code")
            removed = np.sort(unused.limit(layouts.MOST_BROADCAST_TERMS + 1).toArrow().column(0).to_numpy())
            if len(removed) > layouts.MOST_BROADCAST_TERMS:
                return None
        before = dict.fromkeys(range(len(added)), 0)  # terms of the old dictionary between an added one and the one before it
        if added:
            for r in words.select("term").mapInArrow(_between(added), "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
                before[r["i"]] = r["n"]
        places = np.cumsum([before[i] for i in range(len(added))], dtype=np.int64)
        lists = spark.sparkContext.broadcast((removed, places))
        move = (lambda df, *columns: df.mapInArrow(_moved(lists, columns), df.schema)) if added or len(removed) else (lambda df, *_: df)
        fresh_codes = places - np.searchsorted(removed, places) + np.arange(len(added))
        new = spark.createDataFrame(pa.table({"code": pa.array(fresh_codes, pa.int64()), "term": pa.array(added, pa.string())}))
        dropped = F.broadcast(spark.createDataFrame(pa.table({"code": pa.array(removed, pa.int64())})))
        kept = words.join(dropped, "code", "left_anti") if len(removed) else words
        words = written(move(kept.select("code", "term"), "code").union(new.coalesce(1)), f"{at}/dict")
        manifest["terms"] = self.manifest["terms"] - len(removed) + len(added)
        rows, pairs = move(live, *QUAD), move(pairs.select("p", "g"), "p", "g")
        if tail is not None:
            own = written(move(known.select("code", "term"), "code").union(new), fresh(spark, "moved"))
            extra = written(layouts.encoded(tail, own, own.count(), rows=self.manifest["tail_rows"]), fresh(spark, "extra"))
            rows, pairs = rows.union(extra), pairs.union(extra.select("p", "g"))
        for c in "pg":
            few = written(layouts.of_position(pairs, words, "code", c).select("code", "term"), f"{at}/dict_{c}")
            manifest[f"terms_{c}"] = few.count()
        hot = layouts.hot_values(rows, "s", n)["s"]
        return self._laid(layouts.tied(rows) if hot else rows, manifest, n, ["_tie"] if hot else [])

    def compact(self, indexes: Iterable[str] | None = None) -> QuadStore:
        """Base, tail and tombstones as a new base, with a new dictionary, and the same or other indexes."""
        self._owner("compact")
        return self._compacted(self.indexes if indexes is None else indexes)

    def owned(self, path: str | None = None) -> QuadStore:
        """A store of its own, in another folder, of what this view shows."""
        if not self.is_view and path is None:
            return self
        return QuadStore.build(self.quads(), path, self.layout, self.indexes, self.manifest["builder"])


def _packed(spark: SparkSession, quads: list[tuple]) -> DataFrame:
    """Checked quads of three or four terms, as columns."""
    term = lambda q, i: terms.coerced(q[i])
    rows = [(terms.subject(term(q, 0)), terms.predicate(term(q, 1)), terms.term(term(q, 2)), terms.graph(term(q, 3) if len(q) > 3 else "")) for q in quads]
    return spark.createDataFrame(pa.table({c: pa.array([r[i] for r in rows], pa.string()) for i, c in enumerate(QUAD)}))


_BYTES = "part string, bytes binary"


def _stream(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def _streams(part: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def made(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([_stream(batch)], pa.binary())], ["part", "bytes"])

    return made


def _read_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            yield from pa.ipc.open_stream(data.as_buffer())


def _told(table: pa.Table) -> dict:
    """The build options in a table's metadata."""
    about = {k.decode(): v.decode() for k, v in (table.schema.metadata or {}).items()}
    return {k: about[k] for k in ("layout", "builder") if k in about} | ({"indexes": [i for i in about["indexes"].split(",") if i]} if "indexes" in about else {})


def _between(added: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many terms lie before each of the added ones and after the one before it, in the order of their bytes."""

    def counted(batches):
        for batch in batches:
            column, counts = batch.column(0), Counter()
            ends = pc.min_max(column).as_py() if len(column) else None
            if ends and (i := bisect_left(added, ends["min"])) == bisect_left(added, ends["max"]):
                counts[i] = len(column)  # as nearly always, since the dictionary is sorted
            else:
                counts.update(bisect_left(added, x) for x in column.to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([*counts], pa.int64()), pa.array([*counts.values()], pa.int64())], ["i", "n"])

    return counted


def _moved(lists, columns: Iterable[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Codes as they are without the removed ones, with so many new ones at these places."""

    def moved(batches):
        removed, places = lists.value
        for batch in batches:
            out = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for c in columns:
                codes = out[c].to_numpy(zero_copy_only=False)
                out[c] = pa.array(codes - np.searchsorted(removed, codes) + np.searchsorted(places, codes, "right"), pa.int64())
            yield pa.RecordBatch.from_arrays([*out.values()], [*out])

    return moved


def _unencoded(table: pa.Table) -> pa.Table:
    """With Arrow dictionaries as plain columns."""
    plain = lambda c: c.cast(c.type.value_type) if pa.types.is_dictionary(c.type) else c
    return pa.table({name: plain(table.column(name)) for name in table.column_names})
