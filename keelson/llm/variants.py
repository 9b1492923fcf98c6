"""Linking the spellings of names that people typed for the same organisation or person.

Records are sharded by what identifies them besides the name: tax number, e-mail, phone, street, and postal code. Each
shard puts the words of its names into a trie and walks it with the Levenshtein automaton of every word, which gives
the names that share a nearly equal word; their words are then matched in any order, with abbreviations, initials,
dropped vowels, nicknames and joined words, while legal forms and fillers are left aside. Shards that hold very many
records (a desk, a service office) are cut further by keys of the words: words with few edits share a deletion, longer
ones a segment that stays whole, so index and probe words still meet and the result is that of a shard left whole.
Records of a shard with the same name stand there as one, so a shard holds each name once and
links name each record once. Direct links are consolidated into groups, whose members are paired.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.components import connected_components
from keelson.llm.edits import Trie, edits
from keelson.llm.survivor import usable
from keelson.skew import join_by_value
from keelson.storage import durable

#: Records of a shard above which it is cut by keys of its words.
LARGE_SHARD = 200
#: Rows of sub-shards that are handed on together.
ROWS_AT_ONCE = 50_000
#: Members of a group that one task pairs with all others of it.
MEMBERS_AT_ONCE = 1_000
#: Days between the creation dates of two records that share nothing but the postal code and a fitting name; a missing
#: date is no obstacle if the names match in full.
NEAR_DAYS = 366
# Legal forms, as words without dots.
LEGAL = set(
    "gmbh mbh gesellschaft co kg kgaa ohg gbr ag ek ekfm kfm ev ug eg se ltd limited inc incorporated llc lp llp plc corp corporation company "
    "cie sa sas sarl srl spa sl slu bv nv vof cv ab as asa a/s aps oy oyj kk yk sro spol sr ro zoo sp z oo o doo dd kft zrt bt "
    "ltda lda eireli pte pty pvt public liability kabushiki kaisha anonim sti ltdsti "
    "ges limitada aktiebolag aktieselskab anpartsselskab osakeyhtio sociedade spolka akciova spolecnost responsabilita limitata per azioni besloten "
    "spzoo kommanditgesellschaft aktiengesellschaft beschraenkter haftung mit sociedad anonima societe anonyme naamloze vennootschap".split()
)
# Words that tell branches and states apart but not organisations.
FILLERS = set("group gruppe holding west ost nord sued east north south neu new alt old werk plant inh inhaber owner und and the of dept u".split())
# Fixed value: a word that is short for a legal form or for a trade.
EITHER = "comp"
# Short forms of first names, by full form.
NICKNAMES = {
    "antonia": "toni tonia", "anton": "toni", "antonio": "toni", "christina": "chris tina christl", "christine": "chris tina", "alexander": "alex sascha sandro xander al", "andreas": "andi andy dre", "benjamin": "ben benny benni", "charlotte": "lotte charly charlie lotti",
    "christian": "chris christl", "christopher": "chris topher kit", "daniel": "dan danny dani", "edward": "ed ted eddie ned teddy",
    "elisabeth": "elli lisa liesl sissi betty beth ellie lisbeth", "elizabeth": "liz beth betty lizzie eliza", "friedrich": "fritz fred freddy friedel",
    "franz": "franzl", "georg": "schorsch", "heinrich": "heinz heini", "james": "jim jimmy jamie", "johannes": "hans hannes jo", "john": "jack johnny",
    "joseph": "joe jo sepp", "josef": "sepp jupp joe jo", "katharina": "kat kathi kati käthe kaethe katja", "katherine": "kate kathy katie", "margaret": "maggie peggy meg marge",
    "margarete": "grete gretel greta", "maria": "mia mary mitzi", "matthias": "matze mattes", "maximilian": "max maxi", "michael": "mike mick michi michel micha",
    "nicholas": "nick nicky", "patricia": "pat patty trish", "peter": "pete pit", "richard": "dick rick rich richie", "robert": "bob rob bobby robby bert",
    "stefan": "steff steffen", "stephen": "steve stevie", "susanne": "susi sanne suse sue", "susan": "sue susie", "theodor": "theo teddy ted", "theodore": "ted theo",
    "thomas": "tom tommy", "ulrich": "uli ulli", "wilhelm": "willi willy helm", "william": "bill will billy willie liam", "wolfgang": "wolf wolfi",
    "anthony": "tony", "rebecca": "becky", "jennifer": "jenny jen", "samuel": "sam sammy", "barbara": "babs babsi bärbel", "gabriele": "gabi",
    "ursula": "uschi ulla", "sebastian": "basti", "manfred": "manni", "dorothea": "doro thea", "helene": "lena leni",
}
_SHORT = defaultdict(set)
for _full, _forms in NICKNAMES.items():
    for _form in _forms.split():
        _SHORT[_form].add(_full)
_FOLD = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "@": "a"})


_CAMEL = re.compile(r"(?<=[a-zß-öø-ÿ]{2})(?=[A-ZÀ-Þ][a-zß-öø-ÿ.])")
_SRO = re.compile(r"\bs\.?\s?r\.?\s?o\b|\bsp\.?\s?z\.?\s?o\.?\s?o\b")
_EK = re.compile(r"\be\.?\s?kfm\b|\ba/s\b")
_DOTTED = re.compile(r"\b([a-z])\.(?=[a-z]\b)")
_LETTERS = re.compile(r"[a-z]+")


@lru_cache(maxsize=100_000)
def name_words(name: str | None) -> tuple[str, ...]:
    """The words of a name that tell it apart, in order; the legal form and fillers are left out."""
    text = _CAMEL.sub(" ", name or "")
    text = text.lower().translate(_FOLD).replace("'", "")
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).replace("'", "")
    if "o" in text:
        text = _SRO.sub(" sro ", text)
    if "kfm" in text or "a/s" in text:
        text = _EK.sub(" ek ", text)
    if "." in text:
        text = _DOTTED.sub(r"\1", text)
    words = list(dict.fromkeys(_LETTERS.findall(text)))
    kept = [w for w in words if w not in LEGAL and not _is_filler(w)]
    return tuple(kept or words)


@lru_cache(maxsize=100_000)
def _is_filler(word: str) -> bool:
    """A filler, also with letters swapped, or a longer one with a slip."""
    near = lambda f: sorted(f) == sorted(word) or (len(f) > 4 < len(word) and edits(word, f, 1) <= 1)
    return word in FILLERS or (3 < len(word) < 8 and any(near(f) for f in FILLERS if len(f) > 3))


def most_edits(size: int) -> int:
    return 0 if size < 4 else 1 if size < 5 else 2 if size < 12 else 3


def _subsequence(short: str, long: str) -> bool:
    letters = iter(long)
    return all(c in letters for c in short)


def word_match(a: str, b: str) -> str:
    """``full`` for the same word with slips, ``short`` for an abbreviation, nickname or initial, else empty."""
    if a == b:
        return "full"
    short, long = sorted((a, b), key=len)
    if len(short) >= 4 and edits(a, b, most_edits(len(short))) <= most_edits(len(short)):
        return "full"
    if short[0] != long[0]:
        return "short" if _SHORT[a] & (_SHORT[b] | {b}) or a in _SHORT[b] else ""
    if long.startswith(short) or _SHORT[a] & (_SHORT[b] | {b}) or a in _SHORT[b]:
        return "short"
    if len(short) >= 3 and len(short) < len(long) and _subsequence(short, long):
        return "short"
    if 4 <= len(short) < len(long) and edits(short, long[: len(short)], 1) <= 1:
        return "short"
    if 3 <= len(short) <= 4 < len(long) and not set("aeiou") & set(short) and not Counter(short) - Counter(long):
        return "short"
    return ""


@lru_cache(maxsize=100_000)
def names_fit(a: tuple[str, ...], b: tuple[str, ...]) -> str:
    """``full`` if the words of two names match in any order and all in full, ``part`` if at least one longer word does
    and others are short forms, else empty.

    Neighbouring words may be written as one. An initial also stands for a word that follows the one it begins. Names
    of the same words, or of the same letters in a row, match however short their words are.
    """
    if a and b and (sorted(a) == sorted(b) or "".join(a) == "".join(b)):
        return "full"
    if EITHER in a or EITHER in b:
        bare = [tuple(w for w in words if w != EITHER) for words in (a, b)]
        return _words_fit(a, b) or _words_fit(*bare)
    return _words_fit(a, b)


def _places(word: str, following: str, b: tuple[str, ...], free: list[int], i: int) -> tuple[list[int], str, int, int]:
    """The words of ``b`` that ``word`` matches, how, the words of ``a`` used up, and the letters of the shorter side as
    written in one; full matches come first."""
    near = sorted(free, key=lambda j: abs(i - j))
    whole = [(j, [j], word, b[j], 1) for j in near]
    joined = [(j, [j, j + 1], word, b[j] + b[j + 1], 1) for j in near if j + 1 in free]
    taken = [(j, [j], word + following, b[j], 2) for j in near] if following else []
    best: tuple[list[int], str, int, int] = ([], "", 1, 0)
    for _, places, x, y, used in [*whole, *joined, *taken]:
        kind = word_match(x, y)
        letters = min(len(x), len(y))
        if kind == "full":
            return places, kind, used, letters
        # Of abbreviations the one that accounts for most letters is taken.
        if kind and letters > best[3]:
            best = (places, kind, used, letters)
    return best


def _words_fit(a: tuple[str, ...], b: tuple[str, ...]) -> str:
    if not a or not b:
        return ""
    if len(b) < len(a):
        a, b = b, a
    free, full, all_full, i = list(range(len(b))), False, True, 0
    begun: set[int] = set()
    while i < len(a):
        places, kind, used, letters = _places(a[i], a[i + 1] if i + 1 < len(a) else "", b, free, i)
        if not places:
            return ""
        all_full = all_full and kind == "full"
        free = [j for j in free if j not in places]
        full = full or (kind == "full" and letters >= 4)
        if len(a[i]) <= 2:
            begun.add(places[-1] + 1)
        i += used
    if not full or set(free) - begun:
        return ""
    return "full" if all_full and not free else "part"


def _deletions(word: str, most: int) -> set[str]:
    """The word with up to ``most`` letters left out; words within ``most`` edits, swaps included, have one in common."""
    last = found = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        found = found | last
    return found


def _segments(size: int, most: int) -> list[tuple[int, int]]:
    """``most + 1`` segments with a letter left out between neighbours, so that no edit, nor a swap, hits two of them."""
    cut = [(size - most) * i // (most + 1) for i in range(most + 2)]
    return [(a + i, b + i) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False))]


#: Edits up to which deletions are the keys; words that may have more are long enough for segments.
MOST_DELETED = 2


@lru_cache(maxsize=20_000)
def index_keys(word: str) -> frozenset[str]:
    """The keys of a word in the index of a large shard, for each number of edits with which a probe may look for it."""
    keys = set()
    for most in {most_edits(size) for size in range(1, len(word) + 4) if abs(size - len(word)) <= most_edits(size)}:
        if most <= MOST_DELETED:
            keys |= {f"{most}-{d}" for d in _deletions(word, most)}
        else:
            keys |= {f"{len(word)}.{i}.{word[a:b]}" for i, (a, b) in enumerate(_segments(len(word), most))}
    return frozenset(keys)


@lru_cache(maxsize=20_000)
def probe_keys(word: str) -> frozenset[str]:
    """The keys under which a word meets the index keys of all words within ``most_edits`` of it."""
    most = most_edits(len(word))
    if most <= MOST_DELETED:
        return frozenset(f"{most}-{d}" for d in _deletions(word, most))
    keys = set()
    for size in range(len(word) - most, len(word) + most + 1):
        for i, (a, b) in enumerate(_segments(size, most)):
            for start in range(max(0, a - most), min(len(word) - (b - a), a + most) + 1):
                keys.add(f"{size}.{i}.{word[start : start + b - a]}")
    return frozenset(keys)


@lru_cache(maxsize=100_000)
def _meeting(probe: str, word: str) -> str:
    """The one key under which two words are compared, of those they have in common."""
    return min(probe_keys(probe) & index_keys(word))


def _parts(words: tuple[str, ...]) -> set[str]:
    """The words by which names find each other: each word, and all of them written as one."""
    return {*words, "".join(words)}


def evidence(vendors: DataFrame) -> DataFrame:
    """(id, name, created, shard, kind, era): one row for each usable identifying value of a record. ``era`` tells
    records of one postal code apart by the span of ``NEAR_DAYS`` they were created in, -1 for no date; otherwise 0."""
    fields = {
        "T": ("tax_number", F.substring(F.regexp_replace("tax_number", "[^0-9]", ""), -9, 9)),
        "E": ("email", F.lower(F.regexp_replace("email", r"[<>\s ]", ""))),
        "P": ("phone", F.substring(F.regexp_replace("phone", "[^0-9]", ""), -7, 7)),
        "S": ("street", _street_key(F.col("street"))),
        "Z": ("postal_code", F.regexp_replace("postal_code", r"\s", "")),
    }
    pairs = [
        F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(kind), F.when(usable(F.lit(field), F.col(field)), key)).alias("shard"))
        for kind, (field, key) in fields.items()
    ]
    created = F.try_to_date("created_date", "yyyyMMdd").alias("created")
    era = F.when(F.col("kind") != "Z", 0).otherwise(F.coalesce(F.floor(F.unix_date("created") / NEAR_DAYS), F.lit(-1))).cast("int")
    return vendors.select("id", "name", created, F.inline(F.array(*pairs))).where("shard is not null").withColumn("era", era)


def _street_key(street):
    """A street without its type, case and spacing, so that written-out and short types agree."""
    text = F.lower(F.replace(F.replace(F.replace(F.replace(street, F.lit("ß"), F.lit("ss")), F.lit("ä"), F.lit("ae")), F.lit("ü"), F.lit("ue")), F.lit("ö"), F.lit("oe")))
    kinds = r"(strasse|str|street|st|avenue|ave|av|road|rd|lane|ln|boulevard|blvd|platz|pl|gasse|g|weg|allee)\b"
    return F.regexp_replace(F.regexp_replace(text, kinds, ""), r"[^a-z0-9]", "")


def _near_in_time(a: tuple, b: tuple, fit: str) -> bool:
    """Whether two entries (id, first, last) of one postal code were created close enough for names that ``fit``."""
    if a[1] is None or b[1] is None:
        return fit == "full"
    early, late = sorted((a, b), key=lambda entry: entry[1])
    return (late[1] - early[2]).days <= NEAR_DAYS


def _link_shard(rows: list[tuple]) -> Iterator[tuple[str, str]]:
    """Pairs of ids of one shard whose names fit. rows: (kind, id, name, first, last, role, part), one for each name
    and era; role is 1 for index rows, 2 for probes, 3 for both; part is the key of a sub-shard, which compares only
    the words that meet under it."""
    if len(rows) < 2:
        return
    people, roles = defaultdict(list), {}
    kind, part = rows[0][0], rows[0][6]
    for _, ident, name, first, last, role, _ in rows:
        people[name].append((ident, first, last))
        roles[name] = role
    words = {name: name_words(name) for name in people}
    holders = defaultdict(set)
    for name in people:
        if roles[name] & 1:
            for word in _parts(words[name]):
                holders[word].add(name)
    tree = Trie(holders)
    met: dict[str, set[str]] = {name: {name} for name in people}
    for name, entries in people.items():
        for k, entry in enumerate(entries):
            yield from ((entry[0], other[0]) for other in entries[k + 1 :] if kind != "Z" or _near_in_time(entry, other, "full"))
        if roles[name] & 2:
            for other in _candidates(name, words, holders, tree, met, part):
                met[other].add(name)
                fit = names_fit(words[name], words[other]) or names_fit(words[other], words[name])
                if fit:
                    for entry in entries:
                        yield from ((entry[0], near[0]) for near in people[other] if kind != "Z" or _near_in_time(entry, near, fit))


def _candidates(name: str, words: dict, holders: dict, tree: Trie, met: dict[str, set[str]], part: str | None) -> set[str]:
    """The names that share a nearly equal word with ``name`` and that it has not met yet. Once it has met all names of
    the shard, no further word is looked up: equal words come first, then the longest."""
    mine = [word for word in _parts(words[name]) if not part or part in probe_keys(word)]
    known = met[name]
    found: set[str] = set()
    if not part:
        found = found.union(*(holders[word] for word in mine if word in holders)) - known
    for word in sorted(mine, key=len, reverse=True):
        if len(found) + len(known) == len(words):
            break
        for near in tree.near(word, most_edits(len(word))):
            if not part or (part in index_keys(near) and part == _meeting(word, near)):
                found |= holders[near]
        found -= known
    return found


def _link_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shards in order, each possibly over several batches."""

    def links(rows: list[tuple]) -> set[tuple[str, str]]:
        return {(min(pair), max(pair)) for pair in _link_shard(rows)}

    held, shard = [], None
    for batch in batches:
        out = []
        for key, *row in batch[["shard", "kind", "id", "name", "first", "last", "role", "part"]].itertuples(index=False, name=None):
            if key != shard:
                out += links(held)
                held, shard = [], key
            held.append(tuple(row))
        yield pd.DataFrame(out, columns=["a", "b"], dtype="object")
    yield pd.DataFrame(list(links(held)), columns=["a", "b"], dtype="object")


def _cut_large(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of large shards as index and probe rows of sub-shards by the keys of the words."""
    columns = ["kind", "id", "name", "first", "last", "shard", "role", "part"]
    for batch in batches:
        out = []
        for kind, ident, name, first, last, shard in batch[columns[:6]].itertuples(index=False, name=None):
            own = _parts(name_words(name))
            index = {k for w in own for k in index_keys(w)}
            probe = {k for w in own for k in probe_keys(w)}
            out += [(kind, ident, name, first, last, f"{shard}#{k}", (k in index) + 2 * (k in probe), k) for k in index | probe]
            if len(out) > ROWS_AT_ONCE:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)


def direct_links(vendors: DataFrame) -> DataFrame:
    """(a, b) of records (id, name, ...) that share an identifying value and whose names fit.

    Records with the same name, value and era are linked to the first of them and go on as one entry, so neither the
    links nor what a shard holds grow with the square of its records.
    """
    rows = durable(evidence(vendors))
    same = ["shard", "name", "era"]
    entries = durable(
        rows.groupBy(*same, "kind").agg(
            F.min("id").alias("first_id"), F.min("created").alias("first"), F.max("created").alias("last"), F.count(F.lit(1)).alias("n")
        )
    )
    copies = join_by_value(rows.select(*same, "id"), entries.where("n > 1").select(*same, "first_id", "n"), same, "n")
    stars = copies.where("id <> first_id").select(F.col("first_id").alias("a"), F.col("id").alias("b"))
    sizes = durable(entries.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("size", F.col("n")))
    kept = ["kind", F.col("first_id").alias("id"), "name", "first", "last", "shard"]
    sized = join_by_value(entries.select(*kept), sizes, ["shard"], "n")
    small = sized.where(F.col("size") <= LARGE_SHARD).drop("size").withColumn("role", F.lit(3)).withColumn("part", F.lit(None).cast("string"))
    schema = "kind string, id string, name string, first date, last date, shard string, role int, part string"
    columns = ["kind", "id", "name", "first", "last", "shard"]
    large = sized.where(F.col("size") > LARGE_SHARD).select(*columns).mapInPandas(_cut_large, schema)
    sharded = small.select(*columns, "role", "part").unionByName(large).repartition("shard").sortWithinPartitions("shard")
    return sharded.mapInPandas(_link_batches, "a string, b string").unionByName(stars).distinct()


def name_variants(vendors: DataFrame) -> DataFrame:
    """(legacy_vendor_id_a, legacy_vendor_id_b), a < b: records of the same organisation or person whose names differ.

    Repeated deliveries of a record count once (the latest loaded_at). Records without id or name link to nothing.
    """
    kept = ["vendor_name", "tax_number", "email", "phone", "street", "postal_code", "created_date"]
    once = (
        vendors.where("legacy_vendor_id is not null and vendor_name is not null")
        .groupBy("legacy_vendor_id").agg(F.max(F.struct("loaded_at", *kept)).alias("r"))
        .select(F.col("legacy_vendor_id").alias("id"), F.col("r.vendor_name").alias("name"), *(f"r.{c}" for c in kept[1:]))
    )
    once = durable(once)
    groups = durable(connected_components(direct_links(once)).join(once.select("id", "name"), "id"))
    # The members of a large group are dealt out, so that its pairs are made in as many tasks as it needs.
    sizes = groups.groupBy("group_id").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_AT_ONCE).cast("int").alias("parts"))
    placed = durable(groups.join(sizes, "group_id"))
    left = placed.select(
        "group_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("legacy_vendor_id_a"), F.col("name").alias("name_a")
    )
    right = placed.select(
        "group_id", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("legacy_vendor_id_b"), F.col("name").alias("name_b")
    )
    return (
        left.join(right, ["group_id", "part"])
        .where("legacy_vendor_id_a < legacy_vendor_id_b and name_a <> name_b")
        .select("legacy_vendor_id_a", "legacy_vendor_id_b")
    )
