"""Language-model scoring with Brown class bigrams.

Every distinct word of the training texts is counted and gets one of ``CLASSES`` classes by the exchange
criterion: the class that raises the likelihood of the training bigrams most. Three steps do it, each for
the words that the step before has left:

1. the ``CORE`` most frequent words, one word at a time on the driver, from their own bigrams;
2. the ``LISTED`` most frequent words, all at once in Spark: a word's counts of classes before and after
   it are weighed with the transitions of each class, and the transitions are counted anew, ``SETTLE``
   times (the batch form of the exchange, for which the classes of a round stay fixed);
3. all other words in the same way, from their listed neighbours.

``CORE`` and ``LISTED`` only say where a word is handled: listed words are looked up inside the tasks,
others are joined. The vocabulary, its counts and its classes have no bound and are a distributed table.
The end of a text is a class of its own. A word has the probability

    mix * P(class | class before) * P(word | class) + (1 - mix) * P(word)

where all three are smoothed by 0.5 and leave a share to a word never seen: it may belong to any class.
Perplexity is ``10 ** (-score / n_tokens)``.

The probability factors into the smoothed count and a term of the two classes, so of a word that is not
listed a text asks its count and its class, once for each distinct text.

Defined results: a null or empty text is one end token; a null id is trained on and never held out; a word
without neighbours of the step's kind goes to the first class; repeated rows are scored alike; without
training texts the vocabulary is empty and every token has the same share; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.llm.common import cut, flat, mix, per_row, prefix_hash, rows_of, slices, span_hash, word_spans

LISTED = 200_000
CORE = 1_000
CLASSES = 48
END_CLASS = CLASSES
KINDS = CLASSES + 1  # classes and the end of a text
UNSEEN = KINDS  # stands for a word without a class
ROUNDS = 6
SETTLE = 3
MIX = 0.6
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
END = np.uint64(0x51ED270B7A64C5A1)  # stands for the end of a text


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 1, F.lit(False))


def tokens_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a slice, each row's words and then its end, and the offsets of the rows."""
    low = LOWER[data]
    starts, ends, words = word_spans(low, off)
    h = span_hash(prefix_hash(low), starts, ends)
    return np.insert(h, words[1:], END), words + np.arange(len(words))


def with_before(label: np.ndarray, at: np.ndarray, begin: int) -> np.ndarray:
    """The label before each token; a text begins where another has ended."""
    before = np.empty_like(label)
    before[1:] = label[:-1]
    before[at[:-1]] = begin
    return before


TYPES = {"word": "long", "other": "long", "slot": "int"}


def counted(training: DataFrame, keys: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], names: tuple[str, ...] = ("word",)) -> DataFrame:
    """How often (n) ``keys`` makes each combination of word, other and slot (as far as in ``names``) from the tokens of the texts."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def folded(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
            rows = {c: np.concatenate([p[c] for p in parts]) for c in (*names, "n")}
            key = rows["word"]
            for c, factor in (("other", 0x9FB21C651E98DF25), ("slot", 0xD1342543DE82EF95)):
                if c in rows:
                    key = mix(key + rows[c].astype(np.uint64) * np.uint64(factor))
            _, first, which = np.unique(key, return_index=True, return_inverse=True)
            return {c: rows[c][first] for c in names} | {"n": np.bincount(which, rows["n"], len(first)).astype(np.int64)}

        def batches_of(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(rows["n"]), 50_000):
                part = {c: v[i : i + 50_000] for c, v in rows.items()}
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32) if c == "slot" else v.view(np.int64)) for c, v in part.items()], names=list(part))

        for batch in batches:
            data, off = flat(batch.column(0))
            for i, j in slices(off):
                made = keys(*tokens_of(data[off[i] : off[j]], off[i : j + 1] - off[i]))
                if not len(made["word"]):
                    continue
                held.append(folded([made | {"n": np.ones(len(made["word"]), np.int64)}]))
                size += len(held[-1]["n"])
                if size > 3_000_000:
                    held = [folded(held)]
                    size = len(held[0]["n"])
                    if size > 1_500_000:  # bounded memory: what is held goes out, the shuffle sums it up
                        yield from batches_of(held[0])
                        held, size = [], 0
        if held:
            yield from batches_of(folded(held))

    parts = training.select("text").mapInArrow(job, ", ".join(f"{c} {TYPES[c]}" for c in names) + ", n long")
    # Dealt by the word alone, so that what follows for each word needs no other shuffle.
    return parts.repartition("word").groupBy(*names).agg(F.sum("n").alias("n"))


def count_words(training: DataFrame) -> DataFrame:
    """(word, n): the hash of every distinct token of the training texts and its count."""
    return counted(training, lambda h, at: {"word": h})


def most_frequent(counts: DataFrame, k: int) -> pd.DataFrame:
    """About the k most frequent words, by falling count; what is sent to the driver is little more than that.

    A histogram of counts tells the count from which on words are taken, and which share (by hash) of the
    words of that last bin.
    """
    bin_of = F.floor(F.log2("n") * 8)
    bins = sorted(((r["bin"], r["count"]) for r in counts.groupBy(bin_of.alias("bin")).count().collect()), reverse=True)
    taken, lowest, share = 0, -1, 1.0
    for at, n in bins:
        if taken + n > k:
            lowest, share = at, 1.1 * (k - taken) / n
            break
        taken += n
    some = counts.where((bin_of > lowest) | ((bin_of == lowest) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) <= int(min(share, 1.0) * (1 << 30)))))
    return some.toPandas().sort_values(["n", "word"], ascending=[False, True], kind="stable").head(k)


@dataclass
class Lexicon:
    """Words that the tasks hold: by hash, with their counts and classes."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each listed hash, and whether it is listed."""
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return at, self.words[at] == h

    def label(self, h: np.ndarray, other: int = -1) -> np.ndarray:
        at, known = self.find(h)
        return np.where(known, self.classes[at], other)


def exchange(pairs: np.ndarray, n: np.ndarray, words: int, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of ``words`` words (by falling frequency) from their bigram counts, one word at a time.

    The likelihood of the bigrams under classes is ``sum N(c, d) log N(c, d) - sum N(c.) log N(c.) -
    sum N(.d) log N(.d)`` and a constant; each word is taken out and put where that is largest.
    """
    counts = np.zeros((words, words))
    np.add.at(counts, (pairs[:, 0], pairs[:, 1]), n)
    label = np.arange(words) % max(classes, 1)

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    member = np.zeros((words, classes))
    member[np.arange(words), label] = 1
    to, fro = counts @ member, counts.T @ member  # of each word: counts to and from each class
    joint = member.T @ to
    for _ in range(rounds):
        moved = 0
        for w in range(words):
            c, own = label[w], counts[w, w]
            right, left = to[w].copy(), fro[w].copy()
            right[c] -= own
            left[c] -= own
            joint[c] -= right
            joint[:, c] -= left
            joint[c, c] -= own
            # Put w into each class d: row d gains right, column d gains left, the corner gains own too.
            row_sum, column_sum = joint.sum(1), joint.sum(0)
            gain = (f(joint + right) - f(joint)).sum(1) + (f(joint + left[:, None]) - f(joint)).sum(0)
            corner = np.diag(joint)
            gain += f(corner + right + left + own) - f(corner + right) - f(corner + left) + f(corner)
            out_total, in_total = right.sum() + own, left.sum() + own
            gain -= f(row_sum + out_total) - f(row_sum) + f(column_sum + in_total) - f(column_sum)
            d = int(np.argmax(gain))
            joint[d] += right
            joint[:, d] += left
            joint[d, d] += own
            if d != c:
                moved += 1
                label[w] = d
                to[:, c] -= counts[:, w]
                to[:, d] += counts[:, w]
                fro[:, c] -= counts[w]
                fro[:, d] += counts[w]
        if not moved:
            break
    return label


def contexts(label: np.ndarray, at: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of a target token and slot of each of its neighbours with a class.

    Slots below KINDS are the class before, others (minus KINDS) the class after. No text goes on after its end.
    """
    before = with_before(label, at, END_CLASS)
    after = np.empty_like(label)
    after[:-1] = label[1:]
    after[at[1:] - 1] = -1
    left, right = np.flatnonzero(target & (before >= 0)), np.flatnonzero(target & (after >= 0))
    return np.concatenate([left, right]), np.concatenate([before[left], KINDS + after[right]])


def weights(seen: np.ndarray) -> np.ndarray:
    """What one neighbour of each slot (row) tells for each class (column), from counts of (class, slot).

    To the first order, a word raises the likelihood of the bigrams by the sum of these over its neighbours.
    """
    w = np.empty((2 * KINDS, len(seen)))
    for side in (slice(0, KINDS), slice(KINDS, 2 * KINDS)):
        part = seen[:, side] + 0.5
        w[side] = np.log(part / part.sum(1, keepdims=True)).T
    return w


def _dense(slots: pa.ListArray) -> np.ndarray:
    """Rows of (slot, n) lists as rows of counts."""
    x = np.zeros((len(slots), 2 * KINDS))
    flat_ = slots.flatten()
    row = np.repeat(np.arange(len(slots)), np.diff(slots.offsets.to_numpy()))
    np.add.at(x, (row, flat_.field("slot").to_numpy()), flat_.field("n").to_numpy())
    return x


SLOTS_DDL = "word long, slots array<struct<slot:int,n:long>>"


def _slots_of(seen: DataFrame) -> DataFrame:
    """One row for each word with its counts of neighbours, at most 2 * KINDS of them."""
    return seen.groupBy("word").agg(F.collect_list(F.struct("slot", "n")).alias("slots"))


def assigned(words: DataFrame, seen: np.ndarray) -> DataFrame:
    """(word, class): the best class of each word of (word, slots)."""
    w = weights(seen)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = np.argmax(_dense(b.column(1)) @ w, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best.astype(np.int32))], names=["word", "class"])

    return words.select("word", "slots").mapInArrow(job, "word long, class int")


def class_slots(words: DataFrame, seen: np.ndarray) -> np.ndarray:
    """Counts of (class, slot) of the words of (word, slots), each in its best class."""
    w = weights(seen)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES, 2 * KINDS))
        for b in batches:
            x = _dense(b.column(1))
            np.add.at(total, np.argmax(x @ w, 1), x)
        c, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(total[c, slot].astype(np.int64))], names=["class", "slot", "n"])

    out = np.zeros((CLASSES, 2 * KINDS))
    for r in words.select("word", "slots").mapInArrow(job, "class int, slot int, n long").groupBy("class", "slot").agg(F.sum("n").alias("n")).collect():
        out[r["class"], r["slot"]] = r["n"]
    return out


@dataclass
class Model:
    lexicon: Lexicon
    classed: DataFrame  # word, n, class of the words that are not listed
    worth: np.ndarray  # log10 of what a smoothed count is worth, of (class before, class); UNSEEN is the last
    total: int  # tokens
    unigram: float  # the sum of all smoothed counts


def worth_of(pairs: np.ndarray, in_class: np.ndarray, kinds: np.ndarray, unigram: float) -> np.ndarray:
    """log10 of the factor of a smoothed count, for each class before (row) and class of the word (column).

    In each class but the end a word never seen has the place of one more word; before it, any class is as
    likely as it is in the whole.
    """
    follow = np.vstack([pairs, pairs.sum(0)]) + 0.5
    follow /= follow.sum(1, keepdims=True)
    size = in_class + 0.5 * (kinds + 1)
    size[END_CLASS] = in_class[END_CLASS] + 0.5
    share = MIX * follow / size
    unseen = share[:, :CLASSES].sum(1, keepdims=True)
    return np.log10(np.hstack([share, unseen]) + (1 - MIX) / unigram)


def not_listed(counts: DataFrame, lexicon: Lexicon) -> DataFrame:
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(~lexicon.find(b.column(0).to_numpy().view(np.uint64))[1]))

    return counts.select("word", "n").mapInArrow(job, "word long, n long")


def fit_core(training: DataFrame, words: np.ndarray, counts: np.ndarray) -> tuple[Lexicon, np.ndarray]:
    """Classes of the core words (by falling count), and counts of (class, slot) of their bigrams."""
    sort = np.argsort(words)
    by_hash, rank = words[sort], sort
    size = len(words) + 1

    def place(h: np.ndarray) -> np.ndarray:
        if not len(by_hash):
            return np.where(h == END, 0, -1)
        at = np.minimum(np.searchsorted(by_hash, h), len(by_hash) - 1)
        return np.where(h == END, size - 1, np.where(by_hash[at] == h, rank[at], -1))

    def keys(h: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        label = place(h)
        before = with_before(label, at, size - 1)
        both = (before >= 0) & (label >= 0)
        return {"word": (before[both] * size + label[both]).astype(np.uint64)}

    found = counted(training, keys).toPandas()
    a, b, n = found["word"].to_numpy() // size, found["word"].to_numpy() % size, found["n"].to_numpy().astype(float)
    inner = (a < size - 1) & (b < size - 1)
    label = exchange(np.stack([a[inner], b[inner]], 1).astype(np.int64), n[inner], size - 1, CLASSES) if size > 1 else np.zeros(0, np.int64)
    kind = np.append(label, END_CLASS)
    joint = np.zeros((KINDS, KINDS))
    np.add.at(joint, (kind[a.astype(np.int64)], kind[b.astype(np.int64)]), n)
    order = np.argsort(np.append(words, END))
    lexicon = Lexicon(np.append(words, END)[order], np.append(counts, 0)[order], kind[order])
    return lexicon, np.concatenate([joint[:, :CLASSES].T, joint[:CLASSES]], 1)


def fit(training: DataFrame) -> Model:
    """Count the words of the training texts, deal them into classes and count the transitions.

    To the driver go the listed words with their classes (about 20 bytes each), at most CORE ** 2 bigram
    counts and tables of classes.
    """
    counts = cut(count_words(training))
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    frequent = most_frequent(counts, LISTED)
    words, n = frequent["word"].to_numpy().astype(np.int64).view(np.uint64), frequent["n"].to_numpy().astype(np.int64)
    ends = int(counts.where(F.col("word") == int(END.view(np.int64))).agg(F.sum("n")).first()[0] or 0)
    words, n = words[words != END], n[words != END]
    core, core_seen = fit_core(training, words[:CORE], n[:CORE])
    listed = np.sort(words[CORE:])

    # The listed words that are not in the core, from the classes of the core words next to them.
    seen, classes = core_seen, pd.DataFrame({"word": [], "class": []})
    if len(listed):

        def beside_core(h: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
            place = np.minimum(np.searchsorted(listed, h), len(listed) - 1)
            token, slot = contexts(core.label(h), at, listed[place] == h)
            return {"word": h[token], "slot": slot}

        table = cut(_slots_of(counted(training, beside_core, ("word", "slot"))))
        for _ in range(SETTLE):
            seen = core_seen + class_slots(table, seen)
        classes = assigned(table, seen).toPandas()
    every = np.concatenate([words, [END]])
    order = np.argsort(every)
    label = pd.Series(np.append(core.label(words, 0), END_CLASS), index=every.view(np.int64))
    label.update(pd.Series(classes["class"].to_numpy(), index=classes["word"].to_numpy().astype(np.int64)))
    lexicon = Lexicon(every[order], np.append(n, ends)[order], label.to_numpy().astype(np.int64)[order])

    # All other words, from the classes of listed words; pairs of listed words are counted on the way.
    def beside_listed(h: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        label = lexicon.label(h)
        rare = label < 0
        token, slot = contexts(label, at, rare)
        before = with_before(label, at, END_CLASS)
        both = np.flatnonzero((before >= 0) & ~rare)
        pair = (before[both] * KINDS + label[both]).astype(np.uint64)
        first = np.zeros(len(h), bool)
        first[at[:-1]] = True
        last = np.flatnonzero(rare & ~first & (before < 0))
        none = np.zeros(len(token) + len(both), np.uint64)
        return {"word": np.concatenate([h[token], pair, h[last - 1]]), "other": np.concatenate([none, h[last]]), "slot": np.concatenate([slot, np.full(len(both), -2), np.full(len(last), -1)])}

    found = cut(counted(training, beside_listed, ("word", "other", "slot")))
    table = cut(_slots_of(found.where("slot >= 0")))
    rare = cut(assigned(table, seen))
    pairs = np.zeros((KINDS, KINDS))
    for r in found.where("slot = -2").select("word", "n").collect():
        pairs[divmod(r["word"], KINDS)] = r["n"]
    slots = class_slots(table, seen)
    pairs[:CLASSES] += slots[:, KINDS:]
    pairs[:, :CLASSES] += slots[:, :KINDS].T
    # Both words not listed: each is looked up.
    label_of = F.coalesce(F.col("class"), F.lit(0))
    lone = found.where("slot = -1").select("word", "other", "n")
    ahead = lone.join(rare, "word", "left").select(F.col("other").alias("word"), label_of.alias("a"), "n")
    for r in ahead.join(rare, "word", "left").groupBy("a", label_of.alias("b")).agg(F.sum("n").alias("n")).collect():
        pairs[r["a"], r["b"]] += r["n"]

    classed = cut(not_listed(counts, lexicon).join(rare, "word", "left").select("word", "n", label_of.alias("class")))
    in_class = np.bincount(lexicon.classes, lexicon.counts, KINDS)
    kinds = np.bincount(lexicon.classes, minlength=KINDS)
    for r in classed.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        in_class[r["class"]] += r["n"]
        kinds[r["class"]] += r["words"]
    unigram = int(total or 0) + 0.5 * (int(distinct) + 1)
    return Model(lexicon, classed, worth_of(pairs, in_class, kinds, unigram), int(total or 0), unigram)


LOCAL_DDL = "key long, check long, n_tokens long, known long, sure double, context double, rare array<struct<word:long,times:int>>, links array<struct<a:int,b:int,times:int>>"


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each run of equal rows, and the lengths of the runs."""
    fresh = np.ones(len(columns[0]), bool)
    fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    head = np.flatnonzero(fresh)
    return head, np.diff(np.append(head, len(columns[0])))


def _lists(row: np.ndarray, rows: int, names: list[str], columns: list[np.ndarray]) -> pa.ListArray:
    struct = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=names)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), struct)


def score_locally(source: DataFrame, model: Model) -> DataFrame:
    """doc_id and what a task knows of each text: sums over listed words, and the other words by their place.

    ``links`` are the pairs of neighbours with a word that is not listed: its class, or KINDS and its index
    in ``rare``.
    """
    lexicon, worth = model.lexicon, model.worth
    log_count = np.log10(lexicon.counts + 0.5)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column(1))
            for i, j in slices(off):
                h, at = tokens_of(data[off[i] : off[j]], off[i : j + 1] - off[i])
                rows = j - i
                place, listed = lexicon.find(h)
                code = np.where(listed, lexicon.classes[place], 0)
                row = rows_of(at)
                # Words that are not listed: each once for its text, numbered.
                lone = np.flatnonzero(~listed)
                order = lone[np.lexsort((h[lone], row[lone]))]
                head, times = _runs(row[order], h[order])
                first_of_row = np.searchsorted(row[order][head], np.arange(rows))
                number = np.repeat(np.arange(len(head)), times)
                code[order] = KINDS + number - first_of_row[row[order]]
                before = with_before(code, at, END_CLASS)
                inner = (code < KINDS) & (before < KINDS)
                context = np.where(inner, worth[np.where(inner, before, 0), np.where(inner, code, 0)], 0.0)
                link = np.flatnonzero(~inner)
                link = link[np.lexsort((code[link], before[link], row[link]))]
                link_head, link_times = _runs(row[link], before[link], code[link])
                link = link[link_head]
                sure = np.where(listed, log_count[place], 0.0)
                word = order[head]
                known = listed & (lexicon.counts[place] > 0)
                starts = at[:-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, rows),
                        pa.array(span_hash(prefix_hash(h), starts, at[1:]).view(np.int64)),
                        batch.column(2).slice(i, rows),
                        pa.array(np.diff(at)),
                        pa.array(per_row(known, at)),
                        pa.array(np.add.reduceat(sure, starts)),
                        pa.array(np.add.reduceat(context, starts)),
                        _lists(row[word], rows, ["word", "times"], [h[word].view(np.int64), times.astype(np.int32)]),
                        _lists(row[link], rows, ["a", "b", "times"], [before[link].astype(np.int32), code[link].astype(np.int32), link_times.astype(np.int32)]),
                    ],
                    names=["doc_id", *(c.split()[0] for c in LOCAL_DDL.split(", "))],
                )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.select("doc_id", "text", F.xxhash64("text")).mapInArrow(job, f"doc_id {kind}, {LOCAL_DDL}")


def link_scores(links: DataFrame, model: Model) -> DataFrame:
    """The columns of ``links`` but links and classes, and the sum over the links of what their classes are worth."""
    worth = model.worth
    names = [c for c in links.columns if c not in ("links", "classes")]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            link, told = b.column(b.schema.get_field_index("links")), b.column(b.schema.get_field_index("classes"))
            part, cuts = link.flatten(), link.offsets.to_numpy() - link.offsets.to_numpy()[0]
            row = np.repeat(np.arange(b.num_rows), np.diff(cuts))
            classes, begin = told.flatten().to_numpy(), told.offsets.to_numpy() - told.offsets.to_numpy()[0]
            classes = np.append(classes, 0)

            def kind(code: np.ndarray, row: np.ndarray = row, begin: np.ndarray = begin, classes: np.ndarray = classes) -> np.ndarray:
                return np.where(code < KINDS, code, classes[np.where(code < KINDS, len(classes) - 1, begin[row] + code - KINDS)])

            value = worth[kind(part.field("a").to_numpy()), kind(part.field("b").to_numpy())] * part.field("times").to_numpy()
            total = np.append(0.0, np.cumsum(value))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(total[cuts[1:]] - total[cuts[:-1]])], names=[*names, "linked"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in links.schema.fields if f.name in names)
    return links.mapInArrow(job, f"{ddl}, linked double")


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each row of ``docs``."""
    source = docs.select("doc_id", "text")
    model = fit(source.where(~held_out(F.col("doc_id"))))
    local = cut(score_locally(source, model))
    # Equal texts ask once; the answers are put together for each text.
    asked = local.where(F.size("rare") > 0).select("key", "check", F.posexplode("rare").alias("at", "r")).select("key", "check", "at", F.col("r.word").alias("word"), F.col("r.times").alias("times")).distinct()
    n = F.coalesce(F.col("n"), F.lit(0))
    told = asked.join(model.classed, "word", "left").groupBy("key", "check").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(n + 0.5)).alias("more"),
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("class", F.lit(UNSEEN)).alias("class"))))["class"].alias("classes"),
    )
    joined = local.drop("rare").join(told, ["key", "check"], "left").drop("key", "check").withColumn("classes", F.coalesce("classes", F.array().cast("array<int>")))
    scored = link_scores(joined, model)
    sure = F.col("sure") + F.coalesce("more", F.lit(0.0))
    score = sure + F.col("context") + F.col("linked")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (sure - F.col("n_tokens") * F.lit(float(np.log10(model.unigram)))).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
