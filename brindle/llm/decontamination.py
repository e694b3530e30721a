"""Benchmark items in training documents, through a positional inverted index that Spark tables hold.

A posting is (term, document, position). ``phrases`` finds every place where a test phrase stands word by word:
terms are counted over all documents, a phrase with a term that none has is out, and the postings of each
phrase's rarest terms are stored in the checkpoint folder. The rarest one's list, moved back by its offset, gives the
places where the phrase may start; the next ones' lists, moved likewise, are intersected with these; what is left
is compared word by word. ``near`` finds places where the rarest terms of an item stand within a span, in any order.

Everything is DataFrame functions. Documents with equal texts (by 128 bits of hashes: odds of one mistake among
2 ** 40 texts are some 2 ** -49) have the same postings, stored once, so thousands of copies cost no more than one.
Test terms are broadcast where they are few (MOST_TERMS, counted beforehand), else joined by a shuffle, where a hot
term's postings are dealt over SALTS tasks. Every other join is by document and position, which no term makes hot.

Words are maximal runs of anything but ASCII signs, spaces and controls, with A-Z lower-cased. A null or empty text
has none. Repeated rows and ids count each for itself; a null id is an id. Empty tables give no match. Long texts are
taken whole. Columns other than the named ones aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, thin

#: Words of a window; an item with fewer is one window.
WINDOW = 10
#: How many of a phrase's rarest terms are intersected before it is compared word by word.
PROBES = 2
#: Test terms or phrases that are broadcast, some 64 MB at most; more are joined by a shuffle, dealt over SALTS.
MOST_TERMS, SALTS = 1 << 19, 16

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII characters that no word has.
_SIGNS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_TEXT = ["_d1", "_d2"]


def _plain(text: Column) -> Column:
    """A text with A-Z lower-cased and spaces for signs, so that no pattern is needed to split it."""
    return F.translate(F.coalesce(text, F.lit("")), _SIGNS + _UPPER, " " * len(_SIGNS) + _UPPER.lower())


def _split(plain: Column) -> Column:
    return F.array_remove(F.split(plain, " "), "")


def words(text: Column) -> Column:
    return _split(_plain(text))


def prepared(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_key, _d1, _d2 (digest of the text), _n (how many words) and _text (see _plain) of each row of docs. Stored, since
    translating texts costs more than what is done with their words afterwards."""
    given = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    digest = [F.xxhash64(given).alias("_d1"), F.xxhash64(F.lit(1), given).alias("_d2")]
    each = docs.select(F.col(f"`{key}`").alias("_key"), *digest, _plain(F.col(f"`{text}`")).alias("_text"))
    return cut(each.select("_key", *_TEXT, F.size(_split(F.col("_text"))).cast("long").alias("_n"), "_text"))


def tokens(texts: DataFrame) -> DataFrame:
    """_d1, _d2, _pos and _word of every word of texts, which have _d1, _d2 and _text."""
    return texts.select(*_TEXT, F.posexplode(_split(F.col("_text"))).alias("_pos", "_word"))


def _few(rows: DataFrame) -> bool:
    return rows.limit(MOST_TERMS + 1).count() <= MOST_TERMS


def _of(found: DataFrame, terms: DataFrame) -> DataFrame:
    """Those of found whose word is among terms (_word), with its hash _h."""
    keyed = found.withColumn("_h", F.xxhash64("_word"))
    wanted = terms.select(F.xxhash64("_word").alias("_h")).distinct()
    if _few(terms):
        return keyed.join(F.broadcast(wanted), "_h", "left_semi")
    near = thin(keyed, wanted, "_h").withColumn("_salt", F.pmod(F.xxhash64(*_TEXT), F.lit(SALTS)))
    dealt = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return near.join(dealt, ["_h", "_salt"], "left_semi").drop("_salt")


def _by_word(postings: DataFrame, slots: DataFrame) -> DataFrame:
    """postings joined with slots on _word."""
    if _few(slots):
        return postings.join(F.broadcast(slots), "_word")
    near = postings.withColumn("_salt", F.pmod(F.xxhash64(*_TEXT), F.lit(SALTS)))
    dealt = slots.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return near.join(dealt, ["_word", "_salt"]).drop("_salt")


def index(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored postings (_word, _d1, _d2, _pos) of the terms (_word) in texts."""
    return cut(_of(tokens(texts), terms).drop("_h").distinct())


def ranked(slots: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """slots (key, _off, _word) with _rank, the place of the word among its key's from the rarest one. Keys with a
    word that no text has are left out."""
    terms = cut(slots.select("_word").distinct())
    counts = cut(_of(tokens(texts), terms).groupBy("_h").agg(F.count("*").alias("_n")))
    both = slots.join(counts, F.xxhash64("_word") == F.col("_h"), "left").drop("_h")
    own = Window.partitionBy(key)
    both = both.withColumn("_all", F.count("*").over(own)).withColumn("_known", F.count("_n").over(own)).filter("_all = _known")
    return cut(both.withColumn("_rank", F.row_number().over(own.orderBy("_n", "_off"))).drop("_all", "_known", "_n"))


def phrases(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """_p, _d1, _d2 and _start of every place where a phrase of wanted (_p, _words) stands in texts (_d1, _d2, _text)."""
    slots = wanted.select("_p", F.posexplode("_words").alias("_off", "_word"))
    slots = ranked(slots, texts, "_p")
    probes = slots.filter(F.col("_rank") <= PROBES)
    postings = index(texts, probes.select("_word").distinct())
    first = probes.filter("_rank = 1").select("_p", "_off", "_word")
    places = _by_word(postings, first).select("_p", *_TEXT, (F.col("_pos") - F.col("_off")).alias("_start")).filter("_start >= 0")
    for k in range(2, PROBES + 1):
        slot = probes.filter(F.col("_rank") == k).select("_p", "_off", "_word")
        # A phrase of fewer words has no such slot and stays.
        with_slot = _with(places, slot)
        expected = with_slot.withColumn("_pos", F.col("_start") + F.col("_off"))
        there = expected.filter("_word IS NOT NULL").join(postings, ["_word", *_TEXT, "_pos"], "left_semi")
        places = there.unionByName(expected.filter("_word IS NULL")).select("_p", *_TEXT, "_start")
    places = cut(places)
    # Word by word, in one text of each digest.
    here = thin(texts, places.select("_d1").distinct(), "_d1").groupBy(*_TEXT).agg(F.first("_text").alias("_text"))
    expected = _with(places, wanted).select("_p", *_TEXT, "_start", F.size("_words").alias("_len"), F.posexplode("_words").alias("_off", "_word"))
    expected = expected.withColumn("_pos", F.col("_start") + F.col("_off"))
    equal = expected.join(tokens(here), [*_TEXT, "_pos", "_word"]).groupBy("_p", *_TEXT, "_start", "_len").agg(F.count("*").alias("_n"))
    return equal.filter("_n = _len").select("_p", *_TEXT, "_start", "_len")


def _with(places: DataFrame, facts: DataFrame) -> DataFrame:
    """places with the facts of their phrase."""
    return places.join(F.broadcast(facts) if _few(facts) else facts, "_p", "left")


def windows(items: DataFrame, key: str = "item_id", text: str = "text", size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The distinct windows of size words of items, as phrases (_p, _words), and whose they are (key, _p)."""
    each = items.select(F.col(f"`{key}`").alias(key), words(F.col(f"`{text}`")).alias("_all")).filter("size(_all) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("_all") - size + 1, F.lit(1)))
    each = cut(each.select(key, F.explode(F.transform(starts, lambda s: F.slice("_all", s, size))).alias("_words")).distinct())
    found = cut(each.select("_words").distinct().withColumn("_p", F.monotonically_increasing_id()))
    return found, cut(each.join(found, "_words").select(key, "_p"))


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """key, n_words, n_hit (words of the document inside any occurrence of a window of any item), n_items (distinct ids
    of items with such a window) and items (these ids as sorted strings) of every row of docs."""
    texts = prepared(docs, key, text)
    wanted, members = windows(items, item)
    found = cut(phrases(texts, wanted))
    hit = found.select(*_TEXT, F.explode(F.sequence("_start", F.col("_start") + F.col("_len") - 1)).alias("_pos")).distinct()
    hit = hit.groupBy(*_TEXT).agg(F.count("*").alias("n_hit"))
    named = members.select("_p", F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("_item"))
    whose = _with(found.select("_p", *_TEXT).distinct(), named).select(*_TEXT, "_item").distinct()
    whose = whose.groupBy(*_TEXT).agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("_item")).alias("items"))
    none = {"n_hit": F.coalesce("n_hit", F.lit(0)), "n_items": F.coalesce("n_items", F.lit(0)), "items": F.coalesce("items", F.array().cast("array<string>"))}
    base = texts.select(F.col("_key").alias(key), *_TEXT, F.col("_n").alias("n_words"))
    return base.join(hit.join(whose, _TEXT), _TEXT, "left").drop(*_TEXT).withColumns({n: c for n, c in none.items()})


def near(docs: DataFrame, items: DataFrame, terms: int = 4, span: int = 50, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """key, item and start (a word's place, from 0) of every place in a row of docs from which all of the item's ``terms``
    rarest distinct words (all it has, if fewer) stand within span words, in any order, one of them first.

    A document is cut into overlapping blocks of positions, so that a group is bounded by the block however long
    the text and however frequent the terms are."""
    texts = prepared(docs, key, text)
    each = items.select(F.col(f"`{item}`").alias(item), F.array_distinct(words(F.col(f"`{text}`"))).alias("_words"))
    each = cut(each.filter("size(_words) > 0").withColumn("_i", F.monotonically_increasing_id()))
    slots = ranked(each.select("_i", F.posexplode("_words").alias("_off", "_word")), texts, "_i").filter(F.col("_rank") <= terms)
    slots = cut(slots.withColumn("_need", F.count("*").over(Window.partitionBy("_i"))).select("_i", "_word", "_rank", "_need"))
    at = _by_word(index(texts, slots.select("_word").distinct()), slots)
    length = 64 * span
    blocks = F.array_distinct(F.array(F.floor((F.col("_pos") - span + 1) / length), F.floor(F.col("_pos") / length)))
    at = at.withColumn("_block", F.explode(blocks))
    ahead = Window.partitionBy("_i", *_TEXT, "_block").orderBy("_pos").rangeBetween(0, span - 1)
    found = at.withColumn("_seen", F.size(F.collect_set("_rank").over(ahead))).filter((F.col("_seen") == F.col("_need")) & (F.floor(F.col("_pos") / length) == F.col("_block")))
    found = found.select("_i", *_TEXT, F.col("_pos").cast("long").alias("start")).join(each.select("_i", item), "_i")
    return texts.select("_key", *_TEXT).join(found, _TEXT).select(F.col("_key").alias(key), item, "start")
