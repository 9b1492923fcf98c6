"""Held-out items that appear in corpus texts.

The items become runs of three words, written without anything but letters and digits, in one Aho-Corasick automaton.
Every text is reduced to the same form and scanned once, so case, accents, punctuation, markup, line breaks and
hyphenation do not matter. Hits of one item that follow the item's own order form pieces; changed words inside a
piece are bridged. A document leaks an item if its best two pieces cover enough words. Runs that a large share of all
items hold (instructions, set phrases) open no piece, but count in a piece that other runs have opened. Items of the
same words are one text with several ids. The documents are not shuffled, and no text is too long.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.storage import durable

RUN = 3
#: Words that the pieces must cover. It is below the 20 words that make a leak, since changed words at the ends of a
#: piece are not seen, and far above the 8 words of a quotation.
LEAST_WORDS = 15
#: Words that hits of any runs must cover, and their share of the pieces: runs that several items share by chance stand
#: close together in texts that leak another item. Pieces of rare runs alone need LEAST_WORDS, bridged ones included.
CERTAIN_WORDS = 20
LEAST_HELD_SHARE = 5 / 6
#: Changed words that a piece may contain in a row, and characters by which a hit may be out of place.
MOST_CHANGED = 6
MOST_SHIFT = 80
#: Different item texts per automaton; more are scanned for in several passes.
ITEMS_PER_PASS = 20_000
#: A run that a larger share of all different item texts holds is not rare, or even a set phrase; so few holders never
#: make one.
RARE_SHARE = 0.015
SET_PHRASE_SHARE = 0.05
FEW_HOLDERS = 2

#: Markup: anything short in angle brackets, tags of any length if they are well formed, and the addresses of links.
_TAG = re.compile(r"</?[a-zA-Z](?:[^<>]{0,80}|[\w:-]*(?:\s+[\w:.@-]+(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'=<>`]+))?)*\s*/?)>")
_ADDRESS = re.compile(r"\]\([^()\s]*\)")
_OTHER = re.compile(r"[\W_]+")


def _bare(text: str) -> str:
    """The text with blanks for markup, so that all else keeps its place."""
    blank = lambda m: " " * len(m.group())
    if "<" in text:
        text = _TAG.sub(blank, text)
    return _ADDRESS.sub(blank, text) if "](" in text else text


def reduced(text: str) -> str:
    """Letters and digits only, folded."""
    return _OTHER.sub("", _plain(_bare(text)))


def _plain(text: str) -> str:
    decomposed = unicodedata.normalize("NFKD", text).casefold()
    return "".join(c for c in decomposed if not unicodedata.combining(c)) if not decomposed.isascii() else decomposed


def _item_words(text: str) -> list[str]:
    """Words as printed; parts of a hyphenated word are words of their own."""
    return [w for w in _OTHER.split(_plain(_bare(text))) if w]


def reduced_offsets(text: str) -> list[int]:
    """For each character of ``reduced(text)`` its place in the original."""
    return [i for i, c in enumerate(_bare(text)) for _ in _OTHER.sub("", _plain(c))]


def _runs(words: list[str]) -> list[str]:
    return ["".join(words[k : k + RUN]) for k in range(len(words) - RUN + 1)]


class Scanner:
    """The automaton over the runs of the texts (ids, words), and the joining of hits to pieces; ``shared`` has
    the runs that are not rare, and whether they are set phrases, which open no piece."""

    def __init__(self, texts: list[tuple[list[int], str]], shared: dict[str, bool]):
        import ahocorasick

        self.ids = [ids for ids, _ in texts]
        runs: dict[str, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for number, (_, text) in enumerate(texts):
            words = text.split(" ")
            ends = list(accumulate(map(len, words)))
            for k, run in enumerate(_runs(words)):
                runs[run][number].append((k, ends[k + RUN - 1]))
        self.automaton = ahocorasick.Automaton()
        for run, places in runs.items():
            self.automaton.add_word(run, (len(run), run not in shared, shared.get(run, False), dict(places)))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def leaks(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, words, first, last) with offsets in the reduced text."""
        if self.empty or not text:
            return []
        hits, phrases = defaultdict(list), []
        for end, (size, rare, phrase, places) in self.automaton.iter(reduced(text)):
            if phrase:
                phrases.append((end, size, places))
                continue
            for number, where in places.items():
                hits[number] += [(end, word, end - item_end, end - size + 1, False, rare) for word, item_end in where]
        out = []
        for number, found in hits.items():
            rare = [hit for hit in found if hit[5]]
            for end, size, places in phrases:
                found += [(end, word, end - item_end, end - size + 1, True, False) for word, item_end in places.get(number, ())]
            best = self._best(found)
            words, held = sum(p[0] for p in best), sum(p[3] for p in best)
            if held < CERTAIN_WORDS or held < LEAST_HELD_SHARE * words:
                best = self._best(rare)
                words = sum(p[0] for p in best)
            if words >= LEAST_WORDS:
                out += [(item_id, words, min(p[1] for p in best), max(p[2] for p in best)) for item_id in self.ids[number]]
        return out

    def _best(self, found: list[tuple]) -> list[tuple[int, int, int, int]]:
        return sorted(self._pieces(sorted(found)), key=lambda p: -p[0])[:2]

    @staticmethod
    def _pieces(found: list[tuple[int, int, int, int, bool, bool]]) -> list[tuple[int, int, int, int]]:
        """(words, first, last, held) of the pieces, held being the words that hits cover: hits whose words go up and whose places keep their distance."""
        pieces, open_pieces = [], []
        for end, word, shift, start, phrase, _ in found:
            for piece in open_pieces:
                if 0 < word - piece["word"] <= RUN + MOST_CHANGED and abs(shift - piece["shift"]) <= MOST_SHIFT:
                    piece.update(word=word, shift=shift, last=end, held=piece["held"] + min(RUN, word - piece["word"]))
                    break
            else:
                if not phrase:
                    open_pieces.append({"from": word, "word": word, "shift": shift, "first": start, "last": end, "held": RUN})
            kept = []
            for piece in open_pieces:
                (kept if end - piece["last"] <= 400 else pieces).append(piece)
            open_pieces = kept
        return [(p["word"] + RUN - p["from"], p["first"], p["last"], p["held"]) for p in [*pieces, *open_pieces]]


def _texts(items: DataFrame) -> DataFrame:
    """(words, ids): the different item texts, as words with a blank between them."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"item_id": batch["item_id"], "words": [" ".join(_item_words(t)) for t in batch["item_text"]]})

    kept = items.select("item_id", "item_text").where("item_id is not null and item_text is not null")
    words = kept.mapInPandas(split, "item_id bigint, words string").where("words <> ''")
    return words.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))


def _shared_runs(texts: DataFrame, count: int) -> dict[str, bool]:
    """The runs that are not rare, and whether they are set phrases; at most 67 times the runs of a text."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"run": [run for text in batch["words"] for run in sorted(set(_runs(text.split(" "))))]}, dtype="object")

    holders = texts.select("words").mapInPandas(split, "run string").groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    rare, phrase = (max(FEW_HOLDERS, share * count) for share in (RARE_SHARE, SET_PHRASE_SHARE))
    return {r["run"]: r["n"] > phrase for r in holders.where(F.col("n") > rare).collect()}


def leaked_items(documents: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, words, first_char, last_char) for every document that holds a passage of an item.

    Offsets are places in the original text. NULL and empty texts and items leak nothing, items without id are left
    out. Other columns are ignored. Repeated rows of a document give repeated rows.
    """
    spark = documents.sparkSession
    texts = durable(_texts(items))
    count = texts.count()
    passes = -(-count // ITEMS_PER_PASS) or 1
    part = F.pmod(F.xxhash64("words"), F.lit(passes))
    common = _shared_runs(texts, count)
    schema = "doc_id bigint, item_id bigint, words int, first_char bigint, last_char bigint"
    result = spark.createDataFrame([], schema)
    for number in range(passes):
        block = [(r["ids"], r["words"]) for r in texts.where(part == number).collect()]
        shared = spark.sparkContext.broadcast((block, common))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            scanner = Scanner(*shared.value)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch[key], batch["text"], strict=True):
                    found = scanner.leaks(text)
                    places = reduced_offsets(text) if found else []
                    rows += [(doc_id, i, w, places[min(a, len(places) - 1)], places[min(b, len(places) - 1)]) for i, w, a, b in found]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words", "first_char", "last_char"])

        found = documents.select(key, "text").where("text is not null").mapInPandas(scan, schema)
        result = found if number == 0 else result.unionByName(found)
    return result
