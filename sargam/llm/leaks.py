"""Evaluation passages inside a corpus, found by template windows and checked word by word and slot by slot."""

from __future__ import annotations

import difflib
import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import BROADCAST_LIMIT_BYTES, cut_lineage
from .forms import visible_form

# Longest windows used; items too short for their threshold get shorter ones.
WINDOW = 3
# Up to so many characters of items their window index goes to the tasks; beyond, windows are joined by a shuffle.
INDEX_LIMIT_CHARS = 4_000_000
_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>")
_WORD = re.compile(r"(?:[^\W_]|[\u0300-\u036f\u0900-\u0963\u0966-\u0dff])+")
# Words for measures, put for one another in re-parameterised questions.
UNITS = frozenset("second seconds minute minutes hour hours day days week weeks month months year years km kg metre metres meter meters mile miles rs rupee rupees percent".split())
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
_INNER_NAME = re.compile(r"(?<=[^\W\dA-Z_] )[A-Z][a-z]+(?![^\W_])|(?<=, )[A-Z][a-z]+(?![^\W_])")
_NAME_MARK = "\x01"
_TOKEN = re.compile(_NAME_MARK + "|" + _WORD.pattern)


def _shown(text: str | None) -> str:
    """The text in its visible form without markup."""
    if not text:
        return ""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    return visible_form(text)


def _folded(text: str) -> str:
    return text.lower() if text.isascii() else visible_form(text, fold_case=True)


def words_of(text: str | None) -> list[str]:
    """Words of a text in one visible form, case folded; markup, punctuation, blanks and line ends do not count."""
    return _WORD.findall(_folded(_shown(text)))


def words_and_kinds(text: str | None) -> tuple[list[str], list[str | None]]:
    """Words of the text, and for each its placeholder: number, measure, name, or None for a plain word.

    Numbers and measures are told by the word alone. A name is a Latin word with a capital first letter after a small
    letter or a comma; since that depends on the typing, windows are made with and without names.
    """
    shown = _shown(text)
    words = _WORD.findall(_folded(shown))
    kinds: list[str | None] = [NUMBER if w[0].isdigit() else UNIT if w in UNITS else None for w in words]
    marked, names = _INNER_NAME.subn(_NAME_MARK, shown)
    if names:
        tokens = _TOKEN.findall(_folded(marked))
        if len(tokens) == len(words):
            kinds = [NAME if t == _NAME_MARK else k for t, k in zip(tokens, kinds)]
    return words, kinds


class _Codes(dict):
    """64-bit code of a word or placeholder, worked out once for each distinct one of a worker."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_CODES = _Codes()


def coded_forms(words: list[str], kinds: list[str | None]) -> list[list[int]]:
    """Codes of the text with numbers and measures as placeholders, and, where it has names, once more with those too."""
    forms = [[_CODES[w if k is None or k == NAME else k] for w, k in zip(words, kinds)]]
    if NAME in kinds:
        forms.append([_CODES[k or w] for w, k in zip(words, kinds)])
    return forms


def window_hashes(forms: list[list[int]], sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(form number, place, hash) of the windows of each form; a code that repeats the one before it counts once, so doubled words change nothing."""
    lengths = [len(f) for f in forms]
    codes = np.array([c for f in forms for c in f], np.uint64)
    owner = np.repeat(np.arange(len(forms)), lengths)
    if len(codes):
        keep = np.concatenate([[True], (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])])
        codes, owner = codes[keep], owner[keep]
    starts = np.searchsorted(owner, np.arange(len(forms)))
    out = []
    for size in sizes:
        count = len(codes) - size + 1
        if count < 1:
            continue
        total = np.full(count, size, np.uint64)
        for k in range(size):
            total = (total ^ (total >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + count]
        whole = owner[:count] == owner[size - 1 : size - 1 + count]
        place = np.arange(count) - starts[owner[:count]]
        out.append((owner[:count][whole], place[whole], total[whole].view(np.int64)))
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def threshold(words: int, codes: int, shortest_run: int, share: float) -> tuple[int, int]:
    """(window size, least number of an item's windows that a case must have) for an item of ``words`` words.

    Of ``codes`` - s + 1 windows of s words each of the n - ceil(share n) lost words breaks s at most, and one
    interruption s - 1; a run of ``shortest_run`` distinct neighbours keeps shortest_run - 2 (s - 1). So no case stays below. The
    size is the largest up to ``WINDOW`` that leaves one window at least.
    """
    lost = words - math.ceil(share * words)
    for size in range(WINDOW, 0, -1):
        least = min(codes - 2 * (size - 1) - size * lost, shortest_run - 2 * (size - 1))
        if least >= 1 or size == 1:
            return size, max(1, least)
    raise AssertionError


class ItemIndex:
    """Windows of the items with what the check needs of each. Rows: (form of item, place, hash)."""

    def __init__(self, items: list[tuple[object, str]], consecutive: int, share: float) -> None:
        self.items = [(i, *words_and_kinds(t)) for i, t in items]
        self.form_item, self.least = [], []
        owners, places, hashes = [], [], []
        for k, (_, words, kinds) in enumerate(self.items):
            for form in coded_forms(words, kinds):
                changes = [1, *(int(a != b) for a, b in zip(form, form[1:]))]
                run = min((sum(changes[i + 1 : i + consecutive]) + 1 for i in range(len(form) - consecutive + 1)), default=consecutive)
                size, least = threshold(len(words), sum(changes), run, share)
                _, place, found = window_hashes([form], [size])
                owners.append(np.full(len(found), len(self.least)))
                places.append(place)
                hashes.append(found)
                self.form_item.append(k)
                self.least.append((size, least))
        none = [np.empty(0, np.int64)]
        owner, place, found = (np.concatenate(x or none) for x in (owners, places, hashes))
        order = np.argsort(found, kind="stable")
        self.owner, self.place, self.hash = owner[order], place[order], found[order]
        self.sizes = sorted({size for size, _ in self.least})
        self.stride = int(self.place.max(initial=0)) + 1

    def candidates(self, owner: np.ndarray, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, windows of the item that the text has) where that is enough, from the windows of texts."""
        low, high = np.searchsorted(self.hash, hashes), np.searchsorted(self.hash, hashes, "right")
        hit = high > low
        counts = (high - low)[hit]
        at = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if counts.size else np.empty(0, np.int64)
        text = np.repeat(owner[hit], counts)
        forms = len(self.least)
        keys = np.unique((text * forms + self.owner[at]) * self.stride + self.place[at]) // self.stride
        keys, shared = np.unique(keys, return_counts=True)
        best: dict[tuple[int, int], int] = {}
        for key, n in zip(keys.tolist(), shared.tolist()):
            t, form = divmod(key, forms)
            if n >= self.least[form][1]:
                pair = (t, self.form_item[form])
                best[pair] = max(n, best.get(pair, 0))
        return sorted((t, i, n) for (t, i), n in best.items())


def alignment(places: dict[str, list[int]], item: list[str], step: int = 3) -> tuple[int, int]:
    """(most words of the item found in order, longest run of consecutive words of the item), from the places of a text's words.

    Words in order: from one matched word to the next at most ``step`` places in the item and in the text
    (single words changed, left out or doubled), but for one jump forward in the text. A run has neighbouring
    words in both, but for one jump. Only the last ``step`` places of the text are kept.
    """
    matches = defaultdict(list)
    for i, word in enumerate(item):
        for j in places.get(word, ()):
            matches[j].append(i)
    lead, run_lead = [0] * (len(item) + step), [0] * (len(item) + step)  # best chain without jump that ends on an item word at any earlier place
    recent: list[tuple[int, dict[int, tuple[int, int, int, int]]]] = []
    best = best_run = 0
    for j in sorted(matches):
        recent = [(at, row) for at, row in recent if at >= j - step]
        row = {}
        for i in matches[j]:
            free = run = 1
            jumped, run_jumped = 1 + max(lead[max(0, i - step) : i], default=0), 1 + (run_lead[i - 1] if i else 0)
            for at, earlier in recent:
                for k in range(i - step, i):
                    if k in earlier:
                        a, b, c, d = earlier[k]
                        free, jumped = max(free, a + 1), max(jumped, b + 1)
                        if at == j - 1 and k == i - 1:
                            run, run_jumped = c + 1, max(run_jumped, d + 1)
            row[i] = (free, jumped, run, run_jumped)
            best, best_run = max(best, free, jumped), max(best_run, run, run_jumped)
        for i, (free, _, run, _) in row.items():
            lead[i], run_lead[i] = max(lead[i], free), max(run_lead[i], run)
        recent.append((j, row))
    return best, best_run


def bound_slots(words: list[str], kinds: list[str | None], item: list[str], item_kinds: list[str | None]) -> tuple[int, int, int, bool]:
    """(template tokens in order, slots filled, slots filled otherwise, whether each value of the item stands for one value everywhere).

    Text and item are aligned as templates, so that a slot meets a slot of its type; the values that meet are bound.
    """
    template, of_item = [k or w for w, k in zip(words, kinds)], [k or w for w, k in zip(item, item_kinds)]
    blocks = difflib.SequenceMatcher(None, of_item, template, autojunk=False).get_matching_blocks()
    bound: dict[tuple[str, str], set[str]] = defaultdict(set)
    slots = changed = 0
    for i, j, n in blocks:
        for k in range(n):
            if (kind := item_kinds[i + k]) is not None:
                slots += 1
                changed += item[i + k] != words[j + k]
                bound[kind, item[i + k]].add(words[j + k])
    return sum(n for _, _, n in blocks), slots, changed, all(len(v) == 1 for v in bound.values())


_FOUND = (("shared", T.IntegerType()), ("in_order", T.IntegerType()), ("run", T.IntegerType()), ("words", T.IntegerType()), ("template_in_order", T.IntegerType()), ("slots", T.IntegerType()), ("slots_changed", T.IntegerType()), ("consistent", T.BooleanType()))


class _Text:
    """A text with the places of its words."""

    def __init__(self, words: list[str], kinds: list[str | None]) -> None:
        self.words, self.kinds, self.places = words, kinds, defaultdict(list)
        for j, word in enumerate(words):
            self.places[word].append(j)

    def compared(self, item: list[str], item_kinds: list[str | None]) -> tuple:
        """in_order, run, words, and the slots within the stretch of the text in which words of the item stand closest."""
        in_order, run = alignment(self.places, item)
        at = sorted(j for w in set(item) for j in self.places.get(w, ()))
        width, best, left = 2 * len(item), (0, 0), 0
        for right, j in enumerate(at):
            while at[left] < j - width:
                left += 1
            best = max(best, (right - left + 1, -at[left]))
        begin = max(0, -best[1] - len(item))
        stretch = slice(begin, begin + width + 2 * len(item))
        return (in_order, run, len(item), *bound_slots(self.words[stretch], self.kinds[stretch], item, item_kinds))


def _leaked_by_index(index: ItemIndex, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, 512):
                texts = [words_and_kinds(t) for t in batch.column(1).slice(at, 512).to_pylist()]
                forms, text_of = [], []
                for k, (words, kinds) in enumerate(texts):
                    for form in coded_forms(words, kinds):
                        forms.append(form)
                        text_of.append(k)
                owner, _, hashes = window_hashes(forms, index.sizes)
                last, text = -1, None
                for k, i, shared in index.candidates(np.array(text_of, np.int64)[owner], hashes):
                    if k != last:
                        last, text = k, _Text(*texts[k])
                    ident, words, kinds = index.items[i]
                    rows.append((batch.column(0)[at + k].as_py(), ident, shared, *text.compared(words, kinds)))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

    return run


def _document_windows(sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.unique(window_hashes(coded_forms(*words_and_kinds(t)), sizes)[2]) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int32)
            flat = np.concatenate([*hashes, np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc", "hashes"])

    return run


def _item_windows(consecutive: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                index = ItemIndex([(ident, text)], consecutive, share)
                rows += [(ident, f, p, index.least[f][1], h) for f, p, h in zip(index.owner.tolist(), index.place.tolist(), index.hash.tolist())]
            types = (batch.column(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=["item", "form", "place", "least", "hash"])

    return run


@F.pandas_udf(T.StructType([T.StructField(n, t) for n, t in _FOUND[1:]]))
def _compared(documents: pd.Series, items: pd.Series) -> pd.DataFrame:
    rows, last, text, known = [], None, None, {}
    for document, item in zip(documents, items):
        if text is None or document != last:
            last, text = document, _Text(*words_and_kinds(document))
        if item not in known:
            known[item] = words_and_kinds(item)
        rows.append(text.compared(*known[item]))
    return pd.DataFrame(rows, columns=[n for n, _ in _FOUND[1:]])


def leaked_items(
    corpus: DataFrame, ident: str, text: str, items: DataFrame, item_ident: str, item_text: str, consecutive: int = 12, share: float = 0.75, index_limit: int = INDEX_LIMIT_CHARS
) -> DataFrame:
    """Candidate pairs (doc, item) that share template windows, with what the checks found.

    Columns: doc, item, shared (windows of the item that the text has), in_order (item words found in order), run
    (longest run of consecutive item words), words (of the item), template_in_order (the same with placeholders),
    slots, slots_changed (numbers, measures and names that meet one another, and those of other values), consistent
    (each value of the item is replaced by one value throughout).

    Template windows are joined by hash, on the words and, where a text has names, on names as placeholders too. How many windows a pair must share
    follows from ``consecutive`` and ``share`` (``threshold``): no text that holds so many words in a row, or
    such a share in order with single words changed, left out or doubled, interrupted once, has fewer. Up to
    ``index_limit`` characters of items (counted) their index goes to the tasks that read the corpus, so no text is
    shuffled; a longer list is joined by a shuffle of window hashes, and only texts of candidates are read again. Both ways give the same rows.

    Null and empty texts and null identifiers give no row; a repeated document gives a row by its own
    identifier, each repeated row one. Empty input on either side: empty result.
    """
    corpus = corpus.select(F.col(ident).alias("doc"), F.col(text).alias("doc_text")).where("doc is not null and doc_text is not null")
    items = items.select(F.col(item_ident).alias("item"), F.col(item_text).alias("item_text")).where("item is not null and item_text is not null").distinct()
    schema = T.StructType([T.StructField("doc", corpus.schema["doc"].dataType), T.StructField("item", items.schema["item"].dataType), *[T.StructField(n, t) for n, t in _FOUND]])
    chars = items.agg(F.sum(F.length("item_text"))).first()[0] or 0
    if chars <= index_limit:
        from pyspark.sql.pandas.types import to_arrow_schema

        index = ItemIndex([tuple(r) for r in items.collect()], consecutive, share)  # bounded by the count above
        return corpus.mapInArrow(_leaked_by_index(index, to_arrow_schema(schema)), schema)
    item_type = T.StructType([T.StructField("item", schema["item"].dataType), *[T.StructField(n, T.IntegerType()) for n in ("form", "place", "least")], T.StructField("hash", T.LongType())])
    windows_type = T.StructType([T.StructField("doc", schema["doc"].dataType), T.StructField("hashes", T.ArrayType(T.LongType()))])
    windows = corpus.mapInArrow(_document_windows(list(range(1, WINDOW + 1))), windows_type).select("doc", F.explode("hashes").alias("hash")).distinct()
    shared = (
        windows.join(items.mapInArrow(_item_windows(consecutive, share), item_type), "hash")
        .groupBy("doc", "item", "form", "least")
        .agg(F.countDistinct("place").alias("shared"))
        .where("shared >= least")
        .groupBy("doc", "item")
        .agg(F.max("shared").cast("int").alias("shared"))
    )
    shared = cut_lineage(shared)
    wanted = shared.select("doc").distinct()
    few = wanted.count() * 64 <= BROADCAST_LIMIT_BYTES
    texts = corpus.join(F.broadcast(wanted) if few else wanted, "doc", "left_semi")  # so that texts without a candidate are not shuffled
    pairs = texts.join(shared, "doc").join(items, "item")
    return pairs.select("doc", "item", "shared", _compared("doc_text", "item_text").alias("c")).select("doc", "item", "shared", "c.*")


def leaks(corpus: DataFrame, ident: str, text: str, items: DataFrame, item_ident: str, item_text: str, consecutive: int = 12, share: float = 0.75) -> DataFrame:
    """(doc, item) where the document holds ``consecutive`` words of the item in a row, or ``share`` of its words in order."""
    found = leaked_items(corpus, ident, text, items, item_ident, item_text, consecutive, share)
    return found.where((F.col("run") >= consecutive) | (F.col("in_order") >= share * F.col("words"))).select("doc", "item").distinct()


def reparameterised(corpus: DataFrame, ident: str, text: str, items: DataFrame, item_ident: str, item_text: str, share: float = 0.75) -> DataFrame:
    """(doc, item, slots, slots_changed) where the document holds ``share`` of the item's template with other values put in, each throughout for the same one."""
    found = leaked_items(corpus, ident, text, items, item_ident, item_text, share=share)
    return found.where((F.col("template_in_order") >= share * F.col("words")) & (F.col("slots_changed") > 0) & F.col("consistent")).select("doc", "item", "slots", "slots_changed").distinct()
