"""Mentions of people and vehicles, aliases, and replacing one by the other."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions import fixed
from casewright.operators.components import stage_table
from casewright.operators.ranks import numbered


def titled_names(text: Column) -> Column:
    """Names after a title, the title removed; every hit counts."""
    hits = F.regexp_extract_all(text, F.lit(fixed.TITLED_NAME), F.lit(1))
    return F.transform(hits, lambda h: F.regexp_replace(h, rf"^{fixed.TITLES}\s+", ""))


def capitalised_names(text: Column, *, corrected: bool = False, blocklist: list[str] | None = None) -> Column:
    """Capitalised sequences of two to five words of three letters or more, without any word of the blocklist."""
    hits = F.regexp_extract_all(text, F.lit(fixed.CAPITALISED_CONNECTED if corrected else fixed.CAPITALISED), F.lit(1))
    block = F.array(*map(F.lit, fixed.BLOCKLIST if blocklist is None else blocklist))
    plain = lambda h: F.filter(F.split(h, r"\s+"), lambda w: ~w.isin(*fixed.CONNECTORS))
    fits = lambda h: F.size(F.split(h, r"\s+")).between(2, 5) & F.forall(plain(h), lambda w: F.length(w) >= 3) & ~F.arrays_overlap(F.split(h, r"\s+"), block)
    return F.filter(hits, fits)


def vehicle_mentions(text: Column) -> Column:
    """Hits of all vehicle patterns; a plate after `placas` counts twice, for two patterns name it."""
    hits = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in fixed.VEHICLE_PATTERNS))
    return F.filter(F.transform(hits, lambda h: F.trim(h)), lambda h: F.length(h) >= 3)


def initials(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(fixed.INITIALS), F.lit(1))


def mentions(docs: DataFrame, *, text: str = "text", kinds: dict[str, Column] | None = None) -> DataFrame:
    """(case_id, file, doc_id, kind, name): one row a hit. kinds: array columns by kind."""
    found = kinds or {"PERSONA": F.concat(titled_names(F.col(text)), capitalised_names(F.col(text))), "VEHICULO": vehicle_mentions(F.col(text))}

    def tagged(kind: str):
        return lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name"))

    pairs = F.flatten(F.array(*(F.transform(c, tagged(k)) for k, c in found.items())))
    return docs.select("case_id", "file", "doc_id", F.explode(pairs).alias("m")).select("case_id", "file", "doc_id", "m.kind", "m.name")


def without_blocked(found: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Mentions none of whose words is in the case's blocklist (case_id, word): an anti join on exploded words."""
    hit = found.select("case_id", "kind", "name").distinct().withColumn("word", F.explode(F.split("name", r"\s+"))).join(blocklist, ["case_id", "word"], "left_semi")
    return found.join(hit.select("case_id", "kind", "name").distinct(), ["case_id", "kind", "name"], "left_anti")


def document_frequency(found: DataFrame) -> DataFrame:
    return found.groupBy("case_id", "file", "doc_id", "kind", "name").agg(F.count("*").alias("freq"))


def global_counts(per_doc: DataFrame, *, least: int = 1) -> DataFrame:
    """(case_id, kind, name, mentions, n_files): sums over documents; rows of a fixed size, also for a name in every file."""
    out = name_files(per_doc).groupBy("case_id", "kind", "name").agg(F.sum("mentions").alias("mentions"), F.count("*").alias("n_files"))
    return out.filter(F.col("mentions") >= least)


def name_files(per_doc: DataFrame) -> DataFrame:
    """(case_id, kind, name, file, mentions): the files of each name, one row each."""
    return per_doc.groupBy("case_id", "kind", "name", "file").agg(F.sum("freq").alias("mentions"))


def with_files(names: DataFrame, files: DataFrame) -> DataFrame:
    """names with the sorted list of their files from name_files(); a list is as long as its name has files, so this
    comes last, for the names that are shown."""
    keys = ["case_id", "kind", "name"]
    listed = files.join(names.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_list("file")).alias("files"))
    return names.join(listed, keys, "left")


def global_frequency(per_doc: DataFrame, *, least: int = 1) -> DataFrame:
    """(case_id, kind, name, mentions, files): the sum over documents and the sorted distinct files."""
    return with_files(global_counts(per_doc, least=least), name_files(per_doc)).drop("n_files")


def drop_subsumed(names: DataFrame, *, kind: str = "PERSONA") -> DataFrame:
    """Names without those of the kind that another name at least as frequent contains, in whole words.

    Each name is exploded into its runs of words, so the containment is an equi join.
    """
    people = names.filter(F.col("kind") == kind)
    words = F.split("name", " ")
    runs = people.select("case_id", F.col("name").alias("longer"), F.col("mentions").alias("f"), words.alias("w"))
    runs = runs.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w")))).withColumn("n", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("i") + 1)))
    runs = runs.select("case_id", "longer", "f", F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("name")).filter("name <> longer")
    inside = runs.groupBy("case_id", "name").agg(F.max("f").alias("f"))
    gone = people.join(inside, ["case_id", "name"]).filter("f >= mentions").select("case_id", "kind", "name")
    return names.join(gone, ["case_id", "kind", "name"], "left_anti")


def drop_subsumed_anywhere(names: DataFrame, *, kind: str = "PERSONA") -> DataFrame:
    """As drop_subsumed(), for containment at any character: candidates share the shorter name's rarest trigram."""
    people = names.filter(F.col("kind") == kind)
    grams = people.filter(F.length("name") >= 3).select("case_id", "name", "mentions", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - 2), lambda i: F.substring(F.col("name"), i, F.lit(3))))).alias("g"))
    counts = grams.groupBy("case_id", "g").agg(F.count("*").alias("n"))
    ranked = grams.join(counts, ["case_id", "g"])
    rare = ranked.groupBy("case_id", "name", "mentions").agg(F.min(F.struct("n", "g")).alias("m")).select("case_id", "name", "mentions", F.col("m.g").alias("g"))
    longer = grams.select("case_id", "g", F.col("name").alias("longer"), F.col("mentions").alias("f"))
    gone = rare.join(longer, ["case_id", "g"]).filter("f >= mentions and longer <> name and contains(longer, name)")
    return names.join(gone.select("case_id", F.lit(kind).alias("kind"), "name").distinct(), ["case_id", "kind", "name"], "left_anti")


def assign_aliases(names: DataFrame) -> DataFrame:
    """names (case_id, kind, name, mentions, …) with their alias for a name: KIND_001 … by falling frequency, then name.

    (case_id, kind, alias, real_name, mentions, …); ranks are dealt by ranges, so a case's names needn't fit one task.
    """
    ranked = numbered(names, ["case_id", "kind"], [F.desc("mentions"), "name"], "_cw_rank")
    more = [c for c in names.columns if c not in ("case_id", "kind", "name", "mentions")]
    return ranked.select("case_id", "kind", F.format_string("%s_%03d", "kind", "_cw_rank").alias("alias"), F.col("name").alias("real_name"), "mentions", *more)


def alias_stats(aliases: DataFrame, files: DataFrame) -> DataFrame:
    """(case_id, n_people, n_vehicles, n_files) of aliases and name_files()."""
    per = aliases.groupBy("case_id").agg(F.count_if(F.col("kind") == "PERSONA").alias("n_people"), F.count_if(F.col("kind") == "VEHICULO").alias("n_vehicles"))
    return per.join(files.groupBy("case_id").agg(F.count_distinct("file").alias("n_files")), "case_id", "left")


WORD = re.compile(r"\w+")


def lowered(text: str) -> str:
    """text in lower case, character by character, so places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Replacer:
    """One pass over a text: at every word boundary names are looked up by their first word, the longest first, so cost
    doesn't grow with the number of names. A name stands between word boundaries; one that begins with another sign than
    a word's has its boundary at the end of a word."""

    def __init__(self, table: dict[str, str]):
        self.table = table
        self.sizes: dict[str, list[int]] = {}
        for name in table:
            if name:
                first = WORD.match(name)
                sizes = self.sizes.setdefault(first.group() if first else name[0], [])
                if len(name) not in sizes:
                    sizes.append(len(name))
        for sizes in self.sizes.values():
            sizes.sort(reverse=True)
        self.signs = {first for first in self.sizes if not WORD.match(first)}

    def _end(self, low: str, a: int, first: str) -> int:
        """Where the longest name that begins at a ends, or -1."""
        for size in self.sizes.get(first, ()):
            b = a + size
            if low[a:b] in self.table and b <= len(low) and (b == len(low) or WORD.match(low[b]) is None) == (WORD.match(low[b - 1]) is not None):
                return b
        return -1

    def __call__(self, text: str | None) -> str | None:
        if not text:
            return text
        low = lowered(text)
        out, at = [], 0

        def put(a: int, first: str) -> None:
            nonlocal at
            b = self._end(low, a, first) if a >= at else -1
            if b >= 0:
                out.extend((text[at:a], self.table[low[a:b]]))
                at = b

        for m in WORD.finditer(low):
            if m.group() in self.sizes:
                put(m.start(), m.group())
            if self.signs and low[m.end() : m.end() + 1] in self.signs:
                put(m.end(), low[m.end()])
        out.append(text[at:])
        return "".join(out)


def _hashed(words: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) for w in words], np.int64)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number for two neighbouring words; a lone word's second is 0. Overflow wraps."""
    return first * np.int64(-7046029254386353131) + second


def name_keys(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each lower-case name (the number of its first two words, by which it meets the texts that hold these; the
    number of its first word)."""
    words = [WORD.findall(n)[:2] for n in names]
    one = _hashed([w[0] if w else "" for w in words])
    two = np.where(np.array([len(w) > 1 for w in words], bool), _hashed([w[1] if len(w) > 1 else "" for w in words]), 0)
    return _pair(one, two), one


def text_keys(texts: list[str | None], starts: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The distinct numbers of the words, and of the pairs of neighbouring words, that begin with a word whose number
    `starts` lets pass, and of a name without words."""
    lists = [WORD.findall(lowered(t)) for t in texts if t]
    code, distinct = pd.factorize(np.array([w for words in lists for w in words], object))
    hashes = _hashed(list(distinct))
    able = starts(hashes)
    ends = np.cumsum([len(words) for words in lists], dtype=np.int64)
    inner = able[code]
    inner[ends[ends > 0] - 1] = False  # a text's last word has no neighbour
    at = np.flatnonzero(inner)
    pairs = np.unique(code[at].astype(np.int64) * max(1, len(distinct)) + code[np.minimum(at + 1, len(code) - 1)])
    both = _pair(hashes[pairs // max(1, len(distinct))], hashes[pairs % max(1, len(distinct))]) if len(pairs) else np.zeros(0, np.int64)
    return np.unique(np.concatenate([_pair(hashes[able], np.int64(0)), both, _pair(_hashed([""]), np.int64(0))]))


def _by_case(docs: DataFrame, table: DataFrame, keys, change, text: str, group_chars: int) -> DataFrame:
    """docs with text = change(rows of the case's table as pandas)(text): documents and tables meet by a grouped join.

    A case's documents are dealt over so many salts that a group has about `group_chars` characters. keys(dealt, placed)
    gives the distinct (case_id, _cw_salt, _cw_k) that the texts hold, before or after they are shuffled, and a group gets those rows of the table (case_id,
    _cw_k, …) whose key it holds, so a case's table never travels whole. Nothing runs while the plan is built.
    """
    chars = docs.groupBy("case_id").agg(F.ceil(F.sum(F.coalesce(F.length(text), F.lit(0)) + 1) / group_chars).cast("int").alias("_cw_salts"))
    named = chars.withColumnRenamed("case_id", "_cw_case")
    salted = docs.join(named, F.col("case_id").eqNullSafe(F.col("_cw_case"))).drop("_cw_case")
    columns = F.struct(*docs.columns)
    dealt = salted.select(F.col("case_id"), F.pmod(F.xxhash64("doc_id" if "doc_id" in docs.columns else columns), F.col("_cw_salts")).cast("int").alias("_cw_salt"), *(F.col(c) for c in docs.columns if c != "case_id"))
    placed = dealt.repartition("case_id", "_cw_salt")  # one shuffle of texts: for keys() that reads all of it, and for the join
    held = keys(dealt, placed).select(F.col("case_id").alias("_cw_key"), F.col("_cw_salt").alias("_cw_part"), F.col("_cw_k").alias("_cw_held"))
    rows = held.join(table, F.col("_cw_key").eqNullSafe(F.col("case_id")) & (F.col("_cw_held") == F.col("_cw_k"))).drop("case_id", "_cw_held")
    schema = docs.schema

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return left[schema.names].assign(**{text: left[text].map(change(right))})

    return placed.groupBy("case_id", "_cw_salt").cogroup(rows.groupBy("_cw_key", "_cw_part")).applyInPandas(run, schema)


def _slots(table: DataFrame, bits: int, column: str) -> np.ndarray:
    """A bitmap: which of 2**bits slots the column's numbers fall into."""
    slot = F.pmod(column, F.lit(2**bits))
    words = table.groupBy(F.floor(slot / 64).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({column}, {2**bits}L) % 64 as int))")).alias("word")).toArrow()
    bitmap = np.zeros(2 ** (bits - 6), np.int64)
    bitmap[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return bitmap


def _passes(bitmap: np.ndarray, k: np.ndarray) -> np.ndarray:
    slot = k & np.int64(64 * len(bitmap) - 1)
    return (bitmap[slot >> 6] >> (slot & 63)) & 1 == 1


def pseudonymize(docs: DataFrame, aliases: DataFrame, *, text: str = "text", group_chars: int = 8_000_000) -> DataFrame:
    """docs whose texts have aliases for names: case-insensitive, at every word boundary, the longest name first.

    Of names equal in lower case a person's wins, then the alias with the larger number. A document needs only the
    aliases of its case; one without any keeps its text, and a null text stays null. A group of texts gets the names
    whose first two words stand side by side in it; texts tell only those pairs of words that two bitmaps, of the names'
    first words and of their pairs (64 slots a name, at most 16 MB each), let pass. The lower-case names are written and
    the bitmaps are made when this is called.
    """
    number = F.expr("try_cast(regexp_extract(alias, '([0-9]+)$', 1) as decimal(38, 0))")
    order = F.struct(F.when(F.col("kind") == "PERSONA", 1).otherwise(0), number, F.col("alias"))
    case_type = dict(aliases.dtypes)["case_id"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [lowered(n) for n in batch.column("name").to_pylist()]
            both, first = name_keys(low)
            yield pa.RecordBatch.from_arrays([batch.column("case_id"), pa.array(both), pa.array(first), pa.array(low, pa.string()), batch.column("alias"), batch.column("order")], names=["case_id", "_cw_k", "_cw_first", "low", "alias", "order"])

    named = aliases.filter("real_name <> ''").select("case_id", F.col("real_name").alias("name"), "alias", order.alias("order"))
    kinds = f"case_id {case_type}, _cw_k bigint, _cw_first bigint, low string, alias string, order {named.schema['order'].dataType.simpleString()}"
    table = stage_table(named.mapInArrow(keyed, kinds).groupBy("case_id", "_cw_k", "_cw_first", "low").agg(F.max_by("alias", "order").alias("alias")), "names")
    bits = min(27, max(10, (64 * table.count()).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast([_slots(table, bits, c) for c in ("_cw_k", "_cw_first")])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = pd.DataFrame({c: batch.column(c).to_pylist() for c in ("case_id", "_cw_salt")}, dtype=object)
            texts = batch.column(text).to_pylist()
            for at in place.groupby(["case_id", "_cw_salt"], dropna=False, sort=False).indices.values():
                k = text_keys([texts[i] for i in at], lambda h: _passes(shared.value[1], h))
                k = k[_passes(shared.value[0], k)]
                if len(k):
                    first = pa.array(np.full(len(k), at[0]))
                    yield pa.RecordBatch.from_arrays([batch.column("case_id").take(first), batch.column("_cw_salt").take(first), pa.array(k)], names=["case_id", "_cw_salt", "_cw_k"])

    def keys(_: DataFrame, placed: DataFrame) -> DataFrame:
        return placed.mapInArrow(tell, f"case_id {dict(docs.dtypes)['case_id']}, _cw_salt int, _cw_k bigint").distinct()

    return _by_case(docs, table, keys, lambda t: Replacer(dict(zip(t["low"], t["alias"]))), text, group_chars)


_ALIAS = re.compile(r"(?:PERSONA|VEHICULO)_[0-9]+")


def restore(docs: DataFrame, aliases: DataFrame, *, text: str = "text", group_chars: int = 8_000_000) -> DataFrame:
    """docs whose texts have real names for aliases: tokens of the form KIND_digits, unknown ones stay. A group of texts
    gets the aliases that stand in it; an alias with two names has the first by name."""

    def change(table: pd.DataFrame):
        names = dict(zip(table["_cw_k"], table["real_name"]))
        return lambda t: _ALIAS.sub(lambda m: names.get(m.group(), m.group()), t) if isinstance(t, str) else t

    def keys(dealt: DataFrame, _: DataFrame) -> DataFrame:
        found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(_ALIAS.pattern), F.lit(0)))
        return dealt.select("case_id", "_cw_salt", F.explode(found).alias("_cw_k")).distinct()

    table = aliases.groupBy("case_id", F.col("alias").alias("_cw_k")).agg(F.min("real_name").alias("real_name"))
    return _by_case(docs, table, keys, change, text, group_chars)


def resolve_column(df: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """df with the real name in the place of an alias; unknown values stay."""
    table = aliases.select("case_id", F.col("alias").alias(column), "real_name")
    return df.join(table, ["case_id", column], "left").withColumn(column, F.coalesce("real_name", column)).select(*df.columns)


def resolve_array(df: DataFrame, aliases: DataFrame, column: str, key: str) -> DataFrame:
    """As resolve_column() for an array of aliases, in its order; key names df's rows."""
    each = df.select("case_id", key, F.posexplode(column).alias("_at", "_v"))
    named = resolve_column(each, aliases, "_v")
    back = named.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_v"))), lambda s: s["_v"]).alias("_all"))
    return df.join(back, key, "left").withColumn(column, F.coalesce("_all", column)).select(*df.columns)


def initials_mentions(docs: DataFrame, *, text: str = "text") -> DataFrame:
    return mentions(docs, text=text, kinds={"INICIALES": initials(F.col(text))})
