"""Grouping of spelling variants: words one edit apart, found by pivotal grams.

A word's bigrams are put in one order for all words, rarest first. Its prefix is the bigrams up to the
third of that order; two of them that do not overlap, the rarest such pair by dynamic programming, are
its pivots. One edit spoils one pivot at most. So of two words one edit apart, the pivots of the word
whose prefix ends first hold a bigram of the other's prefix, and as the edit lies on one side of that
bigram, everything on its other side is the same: the bigram stands at the same place counted from the
front or from the back, and the text from there through the bigram is equal. Pivots and prefix bigrams
are joined by that text (with half of the rest, if it is short), lengths that differ by more than one
are left out, and each meeting is verified by its edit distance inside the join.

Words of over 64 characters, in which one bigram may stand at any number of places, are joined by the
half that an edit leaves alone.

Occurrences are counted before words are exchanged, so a frequent word is one row. The order of the
bigrams is one number for each pair of letters, which the alphabet bounds, not the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import stored

# Fixed values of the contract: letters, least length, least count, one run in so many loses a letter.
LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, LOSS, RATIO = 7, 2, 31, 10

ORDINARY = 64  # characters of an ordinary word
TELLING = 6  # characters that tell words apart well enough

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted_words(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n, its occurrences in all documents, for the words long and frequent enough."""
    name = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    # Shorter runs cannot give a word, whether they lose a letter or not.
    runs = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"([{LETTERS}]{{{MIN_LENGTH},}})"))
    found = docs.select(name.alias("name"), F.explode(runs).alias("run"))
    found = found.select("name", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = found.select("run", F.crc32(F.concat_ws(":", "name", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % LOSS == 0, shorter).otherwise(F.col("run"))
    words = hashed.select(word.alias("word")).filter(F.length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_COUNT)


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Place in the order, rarest first, and number of occurrences of each bigram."""
    letters = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.select(F.explode(F.transform(letters, lambda i: F.substr("word", i, F.lit(2)))).alias("gram"))
    found = grams.groupBy("gram").count().collect()  # at most the alphabet squared
    return {r["gram"]: (place, r["count"]) for place, r in enumerate(sorted(found, key=lambda r: (r["count"], r["gram"])))}


def prefix_and_pivots(word: str, order: dict[str, tuple[int, int]]) -> tuple[list[int], tuple[int, int], int]:
    """Positions of the prefix's bigrams, the two pivots' positions, and the last bigram's place.

    All occurrences of the last bigram belong to the prefix, so that a bigram is in it wherever it stands.
    """
    grams = [order[word[i : i + 2]] for i in range(len(word) - 1)]
    last = sorted(place for place, _ in grams)[2]
    prefix = [i for i, (place, _) in enumerate(grams) if place <= last]
    # Over positions from left to right: the rarest bigram that ends before this one, and the best pair.
    best, pair, single, behind = None, (0, 0), None, 0
    for i in prefix:
        while behind < len(prefix) and prefix[behind] <= i - 2:
            weight = (grams[prefix[behind]][1], prefix[behind])
            single = weight if single is None else min(single, weight)
            behind += 1
        if single is not None:
            total = single[0] + grams[i][1]
            if best is None or total < best:
                best, pair = total, (single[1], i)
    return prefix, pair, last


def meeting_keys(word: str, at: int, pivotal: bool) -> list[str]:
    """What another word has to share with this one if an edit leaves the bigram at this place alone.

    The text from one end of the word through the bigram is the same in both. If it is short, the rest is
    halved, and one half is the same, too; a pivot asks for the halves of words of each possible length.
    """
    keys = []
    for side, same, rest in (("<", word[: at + 2], word[at + 2 :]), (">", word[at:], word[:at])):
        if len(same) >= TELLING:
            keys.append(side + same)
            continue
        for other in (-1, 0, 1) if pivotal else (0,):
            size = len(rest) + other
            if size >= 0:
                half = size // 2
                head = f"{side}{len(word) + other}{same}"
                keys += [f"{head}<{rest[:half]}", f"{head}>{rest[max(0, len(rest) - (size - half)) :]}"]
    return keys


def _index(order: dict[str, tuple[int, int]], pivotal: bool):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each key by which a word's pivots, or its prefix bigrams, can meet another word."""
        for batch in batches:
            at, keys, last = [], [], []
            for row, word in enumerate(batch.column(0).to_pylist()):
                prefix, pivots, end = prefix_and_pivots(word, order)
                mine = {k for i in (pivots if pivotal else prefix) for k in meeting_keys(word, i, pivotal)}
                keys += mine
                at += [row] * len(mine)
                last += [end] * len(mine)
            rows = batch.take(pa.array(at, pa.int64()))
            columns = [*rows.columns, pa.array(keys, pa.string()), pa.array(last, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n", "key", "last"])

    return index


def _one_edit(a: Column, b: Column) -> Column:
    close = (F.abs(F.length(a) - F.length(b)) <= 1) & (a != b)
    return close & (F.levenshtein(a, b, 1) == 1)


def _shuffled(keys: DataFrame) -> DataFrame:
    """One side of a join that is not broadcast: Spark takes a word's many keys for as many bytes as the word."""
    return keys.hint("merge")


def _pivotal(words: DataFrame) -> DataFrame:
    """Pairs one edit apart, each at least once in some direction, by pivots and prefixes."""
    order = gram_order(words)

    def part(pivotal: bool, name: str) -> DataFrame:
        rows = words.select("word", "n").mapInArrow(_index(order, pivotal), "word string, n bigint, key string, last int")
        return rows.select(F.xxhash64("key").alias("key"), *(F.col(c).alias(f"{name}_{c}") for c in ("word", "n", "last")))

    meets = (F.col("a_last") <= F.col("b_last")) & _one_edit(F.col("a_word"), F.col("b_word"))
    return part(True, "a").join(_shuffled(part(False, "b")), "key").filter(meets)


def _by_halves(words: DataFrame) -> DataFrame:
    """The same for very long words, by the half that the edit leaves alone.

    A word's halves are looked up among those of words of its length and one more.
    """

    def part(name: str, more: tuple[int, ...]) -> DataFrame:
        def halves(size: Column) -> list[Column]:
            half = (size / 2).cast("int")
            front, back = F.substr("word", F.lit(1), half), F.right("word", size - half)
            return [F.xxhash64(size, F.lit("<"), front), F.xxhash64(size, F.lit(">"), back)]

        sides = F.array(*(side for d in more for side in halves(F.length("word") + d)))
        return words.select(F.explode(sides).alias("side"), *(F.col(c).alias(f"{name}_{c}") for c in ("word", "n")))

    return part("a", (0, 1)).join(_shuffled(part("b", (0,))), "side").filter(_one_edit(F.col("a_word"), F.col("b_word")))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b of every two words one edit apart, once in each direction.

    ``words`` has distinct words of four characters at least, and n. One bigram may stand in a very long
    word any number of times, so words of over 64 characters meet by their halves instead.
    """
    columns = ("a_word", "b_word", "a_n", "b_n")
    length = F.length("word")
    short, long = _pivotal(words.filter(length <= ORDINARY)), _by_halves(words.filter(length >= ORDINARY))
    pairs = short.select(*columns).union(long.select(*columns)).toDF("a", "b", "n_a", "n_b")
    turned = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b"))
    return pairs.union(turned).distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """word and root for the words that have a form: the end of their chain of forms.

    Each round doubles the length of the steps; counts grow tenfold along a chain, so a handful of rounds do.
    """
    links = stored(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        moved = stored(moved, "forms")
        links = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return links


def spelling_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n for every word of the documents.

    Words are the maximal runs of letters, A-Z in lower case; of every 31st run by hash one letter is
    deleted. A word has 7 characters and 2 occurrences at least. ``form`` is the near word of largest n
    (ties: the smallest) if that is ten times the word's n; ``root`` is where forms lead to.

    A null text has no words, as have empty ones and an empty table; a null id hashes as empty. Repeated
    rows count each time. Words may be of any length; other columns are ignored.
    """
    words = stored(counted_words(docs, id_column, text), "words")
    pairs = near_pairs(words)
    best = F.min(F.struct((-F.col("n_b")).alias("minus_n"), F.col("b").alias("form")))
    known = pairs.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    chosen = -F.col("best.minus_n") >= RATIO * F.col("n")
    formed = words.join(known, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(chosen, F.col("best.form")).alias("form"),
        F.when(chosen, -F.col("best.minus_n")).alias("form_n"),
    )
    formed = stored(formed, "words")
    rooted = formed.join(last_forms(formed), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
