"""Problem 3: one stored form for text that looks the same.

Method: the corpus' own words make vocabulary tries, one for each length and first two looks of a word. A word is matched by a
weighted edit automaton that runs over the trie: a look-alike, another width or an ignorable character costs nothing, a
letter that can be taken for more than one other costs 1 for any but its first look, another character, a missing or an extra one
costs 3. Matches up to a cost of 2 are kept, so what is left is decided by the vocabulary: a palochka is read as I, but as l
where only that gives a word. The match gives the canonical spelling (one script before several, then the fewest odd
characters, then the first in order; how often a word occurs does not matter). Words without a match, and all that
is no word, are folded by a table.

Defined cases: width, kind of blank, invisible characters, blanks at the ends, composed or combining accents, look-alike
letters of Latin, Greek, Cyrillic and Armenian, ligatures, numerals made of letters, radicals and compatibility ideographs make no
difference. Letter case, raised and lowered digits, other punctuation and the number of inner blanks do. Null stays null, a text of
nothing visible becomes empty; neither takes part in pairs. Texts of any length are read whole, in one pass.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examloom.llm._common import hot_keys, salted_join, salted_many
from examloom.session import materialize

#: Letters that look like Latin ones, Cyrillic, Greek, then Armenian and others, and the Latin letters they look like.
LOOK_ALIKE_FROM = "АВЕЅІЈКМНОРСТУХаеіјорсухѕԁԛԝһӀӏԌҮү" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲν" + "ՕՏԼօսհոցɡɑ"
LOOK_ALIKE_TO = "ABESIJKMHOPCTYXaeijopcyxsdqwhIlGYy" + "ABEZHIKMNOPTYXocv" + "OSLouhngga"
#: What else these letters can be taken for.
SECOND = {"Ӏ": "l", "ӏ": "I", "І": "l", "Ι": "l", "ǀ": "lI", "∣": "lI", "ı": "i", "З": "3", "Ʒ": "3", "ʒ": "3", "Ч": "4", "б": "6", "ß": "β", "β": "ß"}
#: Words meet in one trie if their first two looks are of the same classes.
CLASSES = ("Il|ǀ∣", "iı", "3ЗƷʒ", "4Ч", "6б", "βß")
SECOND_LOOK, OTHER_EDIT, BUDGET = 1, 3, 2
#: Radicals without a decomposition, and the ideographs they look like.
RADICAL_FROM = "⺅⺈⺌⺍⺒⺓⺘⺝⺟⺠⺡⺣⺩⺬⺭⺮⺰⺶⺷⺻⺼⺾⻁⻂⻄⻅⻆⻈⻉⻋⻌⻐⻑⻒⻓⻔⻖⻘⻙⻚⻛⻜⻝⻟⻠⻢⻣⻤⻥⻦⻧⻨⻩⻪⻬⻮⻰⻲⻳"
RADICAL_TO = "亻刀小小巳幺扌月母民氵灬王示礻竹纟羊羊聿肉艹虎衤西见角讠贝车辶钅長镸长门阝青韦页风飞食飠饣马骨鬼鱼鸟卤麦黄黾齐齿龙亀龟"
#: Dashes that look like a hyphen, and signs that look like a letter or two.
OTHER = {"\u2010": "-", "\u2011": "-", "\u00b5": "μ", "℃": "°C"}
_CLASS_OF = {c: g[0] for g in CLASSES for c in g}
_TABLE = dict(zip(LOOK_ALIKE_FROM, LOOK_ALIKE_TO, strict=True)) | dict(zip(RADICAL_FROM, RADICAL_TO, strict=True)) | OTHER


@lru_cache(maxsize=65_536)
def fold_char(c: str) -> str:
    """What a character looks like; empty for one that is not seen. The rule is Unicode's, the table adds look-alikes."""
    if c in _TABLE:
        return _TABLE[c]
    if c < "\x7f":
        return " " if c.isspace() else "" if c < " " else c
    kind = unicodedata.category(c)
    if kind in ("Zs", "Zl", "Zp") or c == "\x85":
        return " "
    if kind in ("Cf", "Cc") or "\ufe00" <= c <= "\ufe0f" or c in "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0":
        return ""
    how = unicodedata.decomposition(c)
    if not how:
        return c
    tag = how.split(" ", 1)[0]
    if tag[0] != "<":  # canonical: accents, compatibility ideographs
        return "".join(map(fold_char, unicodedata.normalize("NFD", c)))
    if tag in ("<wide>", "<narrow>", "<noBreak>") or tag == "<compat>" and ("⺀" <= c <= "⿟" or "\ufb00" <= c <= "\ufb06" or "Ⅰ" <= c <= "ⅿ"):
        return "".join(map(fold_char, unicodedata.normalize("NFKD", c)))
    return c


class _Table(dict):
    """A translation table that works out a character when it first meets it; str.translate then runs at full speed."""

    def __init__(self, rule):
        super().__init__()
        self.rule = rule

    def __missing__(self, code: int) -> str:
        self[code] = out = self.rule(chr(code))
        return out


_FOLDED = _Table(fold_char)


def path_of(text: str) -> str:
    """The folded characters of a text with accents apart: equal for texts that look the same."""
    return unicodedata.normalize("NFD", text.translate(_FOLDED))


def fold(text: str | None) -> str | None:
    """The form that the table alone gives."""
    if text is None:
        return None
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.replace("\r\n", "\n")).translate(_FOLDED)).strip(" ")


class Trie:
    """Words by their visible characters. A node is a dict of edges; the key None holds the word that ends there."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str) -> None:
        """Add a spelling; the first of several that look the same stays."""
        node = self.root
        for c in path_of(word):
            node = node.setdefault(c, {})
        node.setdefault(None, word)

    def match(self, word: str, budget: int = BUDGET) -> tuple[str, int] | None:
        """(spelling, cost) of the cheapest word within budget; ties go to the first in order.

        States are (node, cost) pairs, advanced character by character. A character that is not seen keeps the state; one
        that looks like the edge moves on for nothing, by its second look for SECOND_LOOK; a substitution, a missing or an
        extra character costs OTHER_EDIT.
        """
        states = self._closure({id(self.root): (self.root, 0)}, budget)
        for c in unicodedata.normalize("NFD", word):
            looks = unicodedata.normalize("NFD", fold_char(c))
            for seen in looks:
                step: dict[int, tuple[dict, int]] = {}
                for node, cost in states.values():
                    if seen in node:
                        self._keep(step, node[seen], cost)
                    for other in SECOND.get(c, "") if cost + SECOND_LOOK <= budget else "":
                        if other in node:
                            self._keep(step, node[other], cost + SECOND_LOOK)
                    if cost + OTHER_EDIT <= budget:
                        self._keep(step, node, cost + OTHER_EDIT)
                        for edge, below in node.items():
                            if edge is not None and edge != seen:
                                self._keep(step, below, cost + OTHER_EDIT)
                states = self._closure(step, budget)
                if not states:
                    return None
        ends = [(cost, node[None]) for node, cost in states.values() if None in node]
        return min(ends)[::-1] if ends else None

    @staticmethod
    def _keep(step: dict, node: dict, cost: int) -> None:
        if id(node) not in step or cost < step[id(node)][1]:
            step[id(node)] = (node, cost)

    @staticmethod
    def _closure(states: dict, budget: int) -> dict:
        """States reached by characters that only the trie has."""
        if budget >= OTHER_EDIT:
            queue = list(states.values())
            for node, cost in queue:
                if cost + OTHER_EDIT <= budget:
                    for edge, below in node.items():
                        if edge is not None and (id(below) not in states or cost + OTHER_EDIT < states[id(below)][1]):
                            states[id(below)] = (below, cost + OTHER_EDIT)
                            queue.append((below, cost + OTHER_EDIT))
        return states


@lru_cache(maxsize=1)
def _word_pattern():
    import regex

    # letters outside Han and kana, with digits, marks, hyphens and what is not seen between them
    return regex.compile(r"(?:(?![\p{Han}\p{Hiragana}\p{Katakana}])[\p{L}\p{N}])(?:(?![\p{Han}\p{Hiragana}\p{Katakana}])[\p{L}\p{N}\p{M}\p{Cf}\-\u2010\u2011])*")


def words(text: str) -> list[str]:
    return _word_pattern().findall(text)


def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ", 1)[0]


def is_mixed(word: str) -> bool:
    """Whether a part of a word between hyphens has letters of several scripts."""
    return any(len({_script(c) for c in part if c.isalpha()}) > 1 for part in re.split("[-\u2010\u2011]", word))


def is_spelling(word: str) -> bool:
    """Whether a word of the corpus may be a canonical spelling.

    A word that the table leaves alone may. One of look-alike letters may if it has, of the same script, a letter that
    looks like no other (so it is a Greek or Cyrillic word, not a Latin one in disguise).
    """
    if fold(word) == word:
        return True
    if word != unicodedata.normalize("NFC", word):
        return False
    odd = {_script(c) for c in word if fold_char(c) != c and c in LOOK_ALIKE_FROM}
    if len(odd) != 1 or any(fold_char(c) != c and c not in LOOK_ALIKE_FROM for c in word):
        return False
    own = [c for c in word if c.isalpha() and c not in LOOK_ALIKE_FROM]
    return bool(own) and all(_script(c) in odd for c in own)


def shelf_of(word: str) -> str:
    """What words must share to meet in a trie: the number of their looks and the classes of the first two."""
    path = path_of(word)
    return f"{len(path)}:" + "".join(_CLASS_OF.get(c, c) for c in path[:2])


def _unsure(word: str) -> bool:
    """Whether a word must be looked up: the table changes it, it mixes scripts, or a letter of it has a second look."""
    return not word.isascii() and (fold(word) != word or is_mixed(word) or any(c in SECOND for c in word))


def spellings(words: list[str]) -> dict[str, str]:
    """Canonical spellings of the words of a shelf, for those that the table would spell otherwise."""
    unsure = [w for w in words if _unsure(w)]
    if not unsure:
        return {}
    trie, out = Trie(), {}
    for w in sorted(set(words).difference(unsure)):
        trie.add(w)
    odd = lambda w: sum(fold_char(c) != c for c in unicodedata.normalize("NFD", w)) + (w != unicodedata.normalize("NFC", w))
    for w in sorted(set(unsure), key=lambda w: (is_mixed(w), odd(w), w)):
        found = trie.match(w)
        if found is not None:
            if found[0] != fold(w):
                out[w] = found[0]
        elif is_spelling(w):
            trie.add(w)
            if w != fold(w):
                out[w] = w
    return out


def canonical_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, canonical) of every row. key must be unique.

    Words are gathered in the workers before the shuffle. Only words that are not ASCII are looked up, only tries of shelves
    that hold such a word are built, and only texts that hold a word whose canonical spelling differs from the table's
    are joined with it; all others need one pass.
    """
    base = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in batches:
            for t in b.column("text").to_pylist():
                if t:
                    seen.update(words(t))
            if len(seen) > 200_000:  # pass on what was seen, so that a worker's memory stays bounded
                yield _shelved(seen)
                seen = set()
        yield _shelved(seen)

    def _shelved(seen: set) -> pa.RecordBatch:
        known = list(seen)
        return pa.RecordBatch.from_arrays([pa.array(map(shelf_of, known), pa.string()), pa.array(known, pa.string())], names=["shelf", "word"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, own = None, []
        for b in batches:
            for s, w in zip(b.column("shelf").to_pylist(), b.column("word").to_pylist(), strict=True):
                if s != shelf:
                    yield _found(own)
                    shelf, own = s, []
                own.append(w)
        yield _found(own)

    def _found(own: list[str]) -> pa.RecordBatch:
        out = spellings(own)
        return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.string())], names=["word", "spelling"])

    vocabulary = base.select("text").mapInArrow(gather, "shelf string, word string").distinct()
    shelves = vocabulary.repartition("shelf").sortWithinPartitions("shelf").select("shelf", "word")
    spelled = materialize(shelves.mapInArrow(look_up, "word string, spelling string"), "spellings")

    def text_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ws = [], []
            for k, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                for w in {w for w in words(t) if not w.isascii()} if t else ():
                    keys.append(k)
                    ws.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column("key").type), pa.array(ws, pa.string())], names=["key", "word"])

    key_type = base.schema["key"].dataType.simpleString()
    respelled = None
    if not spelled.isEmpty():
        hits = base.mapInArrow(text_words, f"key {key_type}, word string").join(spelled, "word")
        respelled = hits.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("word", "spelling"))).alias("spellings"))  # as many as a text has words

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = b.column("spellings").to_pylist() if "spellings" in b.schema.names else [None] * b.num_rows
            out = []
            for t, m in zip(b.column("text").to_pylist(), maps, strict=True):
                if t is not None and m:
                    known = dict(m)
                    # spellings are put aside as private characters while the rest is folded
                    kept: list[str] = []

                    def put(hit, known=known, kept=kept):
                        w = known.get(hit.group())
                        if w is None:
                            return hit.group()
                        kept.append(w)
                        return f"\ue000{len(kept) - 1}\ue001"

                    t = fold(_word_pattern().sub(put, t.replace("\ue000", "\ue002").replace("\ue001", "\ue003")))
                    for i, w in enumerate(kept):
                        t = t.replace(f"\ue000{i}\ue001", w)
                    t = t.replace("\ue002", "\ue000").replace("\ue003", "\ue001")
                else:
                    t = fold(t)
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("text"), pa.array(out, pa.string())], names=["key", "text", "canonical"])

    ready = base if respelled is None else base.join(respelled, "key", "left")
    return ready.mapInArrow(apply, f"key {key_type}, text string, canonical string")


def _odd_classes(df: DataFrame, key: str, text: str, within: str | None) -> DataFrame:
    """(h, key, text, canonical, within) of rows whose text looks like a text that is stored differently."""
    spec = materialize(canonical_text(df.filter(F.col(text) != ""), key, text), "canonical").filter("canonical != ''")
    if within is not None:
        side = df.select(F.col(key).alias("key"), F.col(within).alias("within")).filter("within is not null")
        spec = spec.join(side, "key")
    else:
        spec = spec.withColumn("within", F.lit(""))
    spec = spec.withColumn("h", F.md5(F.concat_ws("\x01", "within", "canonical")))
    stored = spec.groupBy("h").agg(F.min(F.md5("text")).alias("a"), F.max(F.md5("text")).alias("b")).filter("a != b").select("h")
    return spec.join(stored, "h", "left_semi")


def same_looking_classes(df: DataFrame, key: str, text: str, within: str | None = None) -> DataFrame:
    """(key, class, stored, n_stored) of every row whose text looks like one that is stored differently.

    class is the smallest key of the class, stored the smallest key of the rows stored in the same way, n_stored their number
    of ways. One row a document: this form of the result stays as large as its input however often a text occurs.
    """
    odd = materialize(_odd_classes(df, key, text, within).select("h", "key", F.md5("text").alias("as")), "odd")
    ways = odd.groupBy("h", "as").agg(F.min("key").alias("stored"), F.count("*").alias("n"))
    classes = ways.groupBy("h").agg(F.min("stored").alias("class"), F.count("*").alias("n_stored"))
    named = ways.join(classes, "h").select("h", "as", "stored", "class", "n_stored", "n")
    return salted_join(odd, named, ["h", "as"], "n", F.col("key")).select(F.col("key").alias(key), "class", "stored", "n_stored")


def same_looking_pairs(df: DataFrame, key: str, text: str, within: str | None = None) -> DataFrame:
    """(key_a, key_b), key_a < key_b, of rows whose texts look the same but are stored differently.

    within: only rows that are equal in this column are compared. Classes stored in one way make no pair and leave before
    the join, so a text that a third of all rows share costs nothing unless it is also stored differently; then its rows
    are spread over many tasks.
    """
    odd = materialize(_odd_classes(df, key, text, within), "odd")
    hot = odd.groupBy("h").agg(F.count("*").alias("n"))
    a, b = salted_many(odd, odd.select(*odd.columns), "h", hot_keys(hot, ["h"], "n"), "key")
    a, b = a.alias("a"), b.alias("b")
    same = (F.col("a.h") == F.col("b.h")) & (F.col("a._salt") == F.col("b._salt")) & (F.col("a.key") < F.col("b.key")) & (F.col("a.text") != F.col("b.text")) & (F.col("a.canonical") == F.col("b.canonical")) & (F.col("a.within") == F.col("b.within"))
    return a.join(b, same).select(F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b")).distinct()
