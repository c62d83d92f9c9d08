"""Merkle proofs, BPE by tree concatenation and the prefix trie against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from galena.llm import bpe_tree, merkle_manifest, prefix_trie

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


# --- proofs -----------------------------------------------------------------------------------


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_proofs(rows: list[tuple], fanout: int = 16) -> list[tuple]:
    by_source: dict = {}
    for i, text, lang, source, n in rows:
        def leaf(t, i=i, lang=lang, source=source, n=n):
            return sha("".join(map(field, (i, source, lang, n, t))))

        forged = leaf(None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else leaf(text)
        by_source.setdefault(source, []).append((i, leaf(text), forged))

    def climb(nodes: list[str], held: list[list]) -> tuple[str, list]:
        while len(nodes) > 1:
            up, up_held = [], []
            for a in range(0, len(nodes), fanout):
                run = nodes[a : a + fanout]
                up.append(sha("".join(run)))
                up_held.append([(r, path + "".join(run[:j] + run[j + 1 :]), sha("".join([*run[:j], f, *run[j + 1 :]]))) for j in range(len(run)) for r, path, f in held[a + j]])
            nodes, held = up, up_held
        return nodes[0], held[0]

    subroots, held = [], []
    for source in sorted(by_source, key=lambda s: (s is not None, (s or "").encode())):
        leaves = sorted(by_source[source], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        subroot, below = climb([r[1] for r in leaves], [[(r, "", r[2])] for r in leaves])
        subroots.append(subroot)
        held.append([((*r, subroot), path, f) for r, path, f in below])
    if not subroots:
        return []
    root, all_ = climb(subroots, held)
    return [(r[0], r[1], r[3], root, sha(path), f, f == root) for r, path, f in all_]


def docs_of(n: int, sources: list, rng: random.Random) -> list[tuple]:
    return [(i, rng.choice(["Abc é", None, "", "xyz", "HELLO"]), rng.choice(["en", None]), rng.choice(sources), rng.choice([1, None])) for i in range(n)]


@pytest.mark.parametrize("case", ["hot", "many", "one", "two", "lone", "none"])
def test_proofs(spark, case):
    rng = random.Random(case)
    odd = [(3, "T", "en", "a", 1), (None, "T", None, "a", 1), (None, "T", None, "a", 1), (5, "Q", "en", "hot", 1), (5, "Q", "en", "hot", 1), (9000, "A", None, "lone", None)]
    rows, options = {
        "hot": (docs_of(600, [None, "a", "é", "hot", "hot", "hot"], rng) + odd, {}),
        "many": (docs_of(200, [f"s{k}" for k in range(40)], rng) + docs_of(200, ["big"], rng), {"share": 8, "fanout": 4}),
        "one": (docs_of(1, ["a"], rng), {}),
        "two": (docs_of(17, ["a"], rng), {}),
        "lone": ([(k, "A", None, f"s{k}", k) for k in range(20)], {}),
        "none": ([], {}),
    }[case]
    docs = spark.createDataFrame(rows, DOCS).withColumn("leaf", F.lit("x")).withColumn("place", F.lit(7))
    out = merkle_manifest.proofs(docs, **options).select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256), "folded_root", "verified")
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, plain_proofs(rows, options.get("fanout", 16))))
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"


def test_a_changed_text_is_told(spark):
    rows = [(i, "TEXT", "en", "s", 4) for i in range(40)]
    got = {r.doc_id: r.verified for r in merkle_manifest.proof_digests(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 != 0 for i in range(40)}


# --- token ids --------------------------------------------------------------------------------

PIECES = ["a", "b", "ab", "'", "s", "'s", "'ll", "re", " ", "  ", "\n", "\n\n", "é", "ñ", "中", "文", "<|endoftext|>", "<|", "1", "23", "!", "...", "\xa0", "\x1c", "　", "🙂", "the", "́"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@settings(max_examples=250, deadline=None)
@given(st.lists(st.sampled_from(PIECES), min_size=1, max_size=6, unique=True).flatmap(lambda own: st.lists(st.sampled_from(own), max_size=700)), st.sampled_from([16, 37, 150]))
def test_concatenated_ids_are_those_of_the_whole_text(own, part_bytes):
    codec = bpe_tree.codec(VOCABULARY)
    text = "".join(own)
    want = codec.tokenizer.encode(text, add_special_tokens=False).ids
    assert codec.quick is not None and codec.encode(text).tolist() == want
    parts = [codec.encode(p.decode()) for p in bpe_tree.halves(text.encode(), part_bytes)]
    assert codec.concatenate(parts).tolist() == want
    assert codec.decode(np.array(want, bpe_tree.ID)) == codec.tokenizer.decode(want, skip_special_tokens=False) == text


def test_ids_of_no_text_decode_as_the_library_has_it(library):
    codec = bpe_tree.codec(VOCABULARY)
    for ids in ([], [120, 50256, 121], [447, 247], [50_300, 64], [137, 137], [64, 220, 130]):
        assert codec.decode(np.array(ids, bpe_tree.ID)) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("part_bytes", [64, 1000, 32 << 10])
def test_token_digests(spark, library, part_bytes):
    rng = random.Random(1)
    texts = [None, "", " ", "a", "long " * 400, "x" * 5000, " " * 3000, "中文" * 900, "it's " * 50 + "<|endoftext|>" * 40] + ["".join(rng.choices(PIECES, k=300)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (4, texts[4]), (None, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("ids", F.lit(1))
    got = sorted(map(str, map(tuple, bpe_tree.token_digests(docs, VOCABULARY, part_bytes).collect())))
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append(str((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(library.decode(ids, skip_special_tokens=False)))))
    assert got == sorted(want)
    assert bpe_tree.token_digests(docs.limit(0), VOCABULARY).count() == 0


def test_another_kind_of_file_is_left_to_its_library(tmp_path):
    codec = bpe_tree.codec(VOCABULARY)
    changed = Tokenizer.from_file(VOCABULARY)
    changed.add_tokens(["zzz"])
    changed.save(str(tmp_path / "more.json"))
    assert bpe_tree.codec(str(tmp_path / "more.json")).encode("a zzz b").tolist() == changed.encode("a zzz b", add_special_tokens=False).ids
    assert codec.quick is not None


# --- the trie ---------------------------------------------------------------------------------


def plain_trie(rows: list[tuple]) -> list[tuple]:
    own: dict = {}
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(k)] for c, k in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members: dict = {}
    for c, q in rebuilt.items():
        for d in range(len(q) + 1):
            members.setdefault(q[:d], []).append(c)
    children, leaves, saved = (dict.fromkeys(members, 0) for _ in range(3))
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in members:
        for k in range(len(p) + 1):
            leaves[p[:k]] += children[p] == 0
            saved[p[:k]] += (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    ends = {p: ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(p)))) for p, m in members.items()}
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(ends[p])) for p, m in members.items()]


def conversations(n: int, rng: random.Random) -> list[tuple]:
    rows = []
    for c in range(n):
        same = rng.choice(["one", "two"])
        rows += [(c, t, "u" if t < 9 else rng.choice(["a", None]), f"shared {same} é" if t < 4 else rng.choice(["x", None, "zz"])) for t in range(rng.choice([1, 2, 3, 6, 12, 20]))]
    return rows


@pytest.mark.parametrize("limit", [3, 40, 256])
def test_prefix_nodes(spark, limit):
    rows = conversations(80, random.Random(limit)) + [(None, 1, "u", "x"), (5, None, "u", "first"), (7, 2, None, None), (7, 2, None, None)]
    turns = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit(1)).withColumn("head", F.lit("h"))
    out = prefix_trie.prefix_nodes(turns, limit=limit).select(prefix_trie.NAMES[:8])
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, plain_trie(rows)))


def test_copies_and_long_shared_starts(spark, monkeypatch):
    """Ids of equal conversations are hashed over many blocks; what all of a container share is skipped."""
    rows = [(c, t, "u", "same") for c in range(150) for t in range(3)]
    rows += [(1000 + 5 * c, t, "u", f"start {t}" if t < 40 else f"own {c}") for c in range(30) for t in range(42)]
    blocks = prefix_trie.distinct(prefix_trie.rebuild(spark.createDataFrame(rows, TURNS)), block=16)
    assert blocks.agg(F.sum("n")).first()[0] == 180
    monkeypatch.setattr(prefix_trie.distinct, "__defaults__", (16,))
    out = prefix_trie.prefix_nodes(spark.createDataFrame(rows, TURNS), limit=8).select(prefix_trie.NAMES[:8])
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, plain_trie(rows)))


def test_no_conversations(spark):
    assert prefix_trie.prefix_nodes(spark.createDataFrame([], TURNS)).count() == 0
    with pytest.raises(TypeError):
        prefix_trie.prefix_nodes(spark.createDataFrame([("a", 1, "u", "x")], "conv_id string, turn long, role string, text string"))
