"""Token ids, fill-in-middle and alignment: against the libraries, brute force and odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_corpus import SMALL, odd_documents

from placehull.llm import alignment, fillmiddle, mergetable

TRICKY = [
    "", " ", "  ", "a", " a", "a ", "a  b   c", "\n", " \n", "\n\n x", "a\tb\r\n", "▁", "▁a ▁▁b", "<s>hi</s>", "<0x41>", "日本語 😀😀 x", "\x00a b",
    "é ﬁ ① Ω", "====-=-", "#-#=_=#*=_#__*_##=-=_====-==-=_=#____==", " " * 70, "=" * 77, "the " * 9, "x" * 200, "   y", "1 234 567", "<|endoftext|>",
]


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]


def library():
    return sentencepiece.SentencePieceProcessor(model_proto=mergetable.model_bytes())


def test_ids_equal_the_library(texts):
    exact, mine = library(), mergetable.Pieces(mergetable.model_bytes()).encoder()
    random.seed(11)
    pieces = [p for p in mine.pieces.texts.values()]
    mixed = ["".join(random.choice(pieces) for _ in range(random.randrange(1, 9))) for _ in range(3000)]
    marks = ["".join(random.choice("-=_*# a▁\n") for _ in range(random.randrange(1, 50))) for _ in range(3000)]
    long = "".join(random.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(200_000))
    for text in [*TRICKY, *mixed, *marks, *filter(None, texts), long]:
        assert mine.encode(text) == exact.encode(text)


def test_ids_when_the_memories_are_emptied(texts, monkeypatch):
    monkeypatch.setattr(mergetable, "MEMORY", 50)
    monkeypatch.setattr(mergetable, "PAIRS", 50)
    exact, mine = library(), mergetable.Pieces(mergetable.model_bytes()).encoder()
    for text in [*TRICKY, *filter(None, texts[:20])]:
        assert mine.encode(text) == exact.encode(text)


def test_pairs_that_fit_are_those_merging_leaves():
    pieces = mergetable.Pieces(mergetable.model_bytes())
    coder = pieces.encoder()
    random.seed(3)
    tokens = random.sample(sorted(pieces.texts), 400) + [t for t, edge in pieces.edges.items() if edge is None]
    for _ in range(20_000):
        a, b = random.choice(tokens), random.choice(tokens)
        left = mergetable.merged(pieces.texts[a] + pieces.texts[b], pieces.scores)[0]
        assert coder.compatible(a, b) == (left == [pieces.texts[a], pieces.texts[b]])


def test_id_rows(spark):
    docs = odd_documents(spark).withColumnRenamed("hits", "n_tokens")
    rows = mergetable.encode_texts(docs, mergetable.model_bytes()).collect()
    exact, nothing = library(), hashlib.sha256(b"").hexdigest()
    assert len(rows) == 8
    for r in rows:
        ids = exact.encode(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() and (ids or r.ids_sha256 == nothing)
    assert mergetable.encode_texts(odd_documents(spark, True), mergetable.model_bytes()).count() == 0


def test_boundary_set_selects_each_value():
    rng = np.random.default_rng(5)
    dense = np.arange(70_000, 140_000)
    sparse = np.sort(rng.choice(10**6, 900, replace=False)) + 200_000
    half = np.flatnonzero(rng.random(65_536) < 0.5) + 30 * 65_536
    for values in (np.array([], np.int64), np.array([0]), np.array([65_535, 65_536]), np.concatenate((dense, sparse, half))):
        made = fillmiddle.BoundarySet(values)
        assert len(made) == len(values) and [made.select(k) for k in range(len(made))] == values.tolist()
    assert {c.kind for c in made.containers} == {"array", "bitmap", "runs"}


def test_middles_are_whole_lines_and_restored():
    for text in [*TRICKY, "a\nb\n\nc", "\n" * 70_000, "é😀\n" * 9 + "z", "x <P> y", "<M>"]:
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        for doc_id in (None, -1, 0, 5, 6, 10**18):
            n, form, prefix, middle, output = fillmiddle.transform(text, doc_id)
            assert fillmiddle.restore(output, form) == text
            assert (form == "plain") == (not text or any(s in text for s in ("<P>", "<S>", "<M>")))
            assert n == len(lines)
            if form != "plain":
                c = fillmiddle.choice(doc_id, n)
                assert (prefix, middle) == (len("".join(lines[: c.first])), len("".join(lines[c.first : c.second])))


def test_middle_rows(spark):
    made = fillmiddle.fill_in_middle(odd_documents(spark).withColumnRenamed("kept", "form"))
    rows = fillmiddle.digests(made).collect()
    assert len(rows) == 8 and {r.doc_id: r.form for r in rows}[2] == "plain" and {"source", "hits"} <= set(made.columns)
    texts = {r.doc_id: r.text or "" for r in made.collect()}
    assert all(r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)
    assert fillmiddle.digests(fillmiddle.fill_in_middle(odd_documents(spark, True))).count() == 0


def aligned_by_force(texts):
    """Whole texts through both libraries, byte by byte."""
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(alignment.FIRST))
    a.encode_special_tokens = True
    names = {i: t for t, i in a.get_vocab(with_added_tokens=False).items()}
    letters, b = alignment.byte_letters(), library()

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) and b.is_byte(i) else piece.replace("▁", " ").encode()

    per_doc = []
    for text in texts:
        whole = f" {text}"
        ids = a.encode(whole, add_special_tokens=False).ids if text else [], b.encode(text or "")
        parts = [bytes(letters[c] for c in names[i]) for i in ids[0]], [b_bytes(i) for i in ids[1]]
        if not text or any(b"".join(p) != whole.encode() for p in parts):
            per_doc.append(None)
            continue
        covers = [[k for k, p in enumerate(side) for _ in p] for side in parts]  # byte -> token
        links = sorted(set(zip(*covers)))
        ends = [set(np.cumsum([len(p) for p in side]).tolist()) for side in parts]
        cuts, spelled, at = sorted(ends[0] & ends[1]), [], 0
        for cut in cuts:
            spelled.append("|".join(",".join(str(i[k]) for k in sorted(set(c[at:cut]))) for i, c in zip(ids, covers)))
            at = cut
        per_doc.append((ids, [(ids[0][x], ids[1][y]) for x, y in links], spelled))
    count = collections.Counter(pair for d in per_doc if d for pair in set(d[1]))
    top = collections.Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    for d in per_doc:
        if d is None:
            yield (0, 0, 0, 0, 0, 0, "")
        else:
            (x, y), links, groups = d
            yield (
                len(x), len(y), len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links),
                hashlib.sha256(";".join(groups).encode()).hexdigest(),
            )


@pytest.mark.parametrize("rounds", [False, True])
def test_alignment_equals_brute_force(spark, texts, rounds):
    texts = [*TRICKY, None, None, *texts, *texts[:5], "x" * 50_000, "a<|endoftext|>b </s> [INST]", " 日本 語é" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_a", F.lit("x"))
    sizes = {"round_pairs": 9000, "shard_pairs": 500, "branch_rows": 2000} if rounds else {}
    made = alignment.align_texts(docs.repartition(5), alignment.tokenizer_files(), **sizes)
    columns = [*alignment.FIGURES, *alignment.LOOKED_UP, "groups_sha256"]
    got = {r.doc_id: tuple(r[c] for c in columns) for r in made.collect()}
    want = dict(enumerate(aligned_by_force(texts)))
    assert len(got) == len(texts) and {k: (texts[k], got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_alignment_rows(spark):
    rows = alignment.align_texts(odd_documents(spark), alignment.tokenizer_files()).collect()
    assert len(rows) == 8
    by = {r.doc_id: r for r in rows}
    assert by[1].groups_sha256 == "" == by[2].groups_sha256 and by[1].n_links == 0 and by[4].count_sum == by[None].count_sum > 0
    assert alignment.align_texts(odd_documents(spark, True), alignment.tokenizer_files()).count() == 0
    nothing = odd_documents(spark).filter("text is null")
    assert [r.n_a for r in alignment.align_texts(nothing, alignment.tokenizer_files()).collect()] == [0]


def test_perfect_hash_places_and_verifies():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 70_000):
        keys = np.unique(rng.integers(0, 1 << 48, n))
        words, starts, placed = alignment.build_hash(keys)
        found = alignment.Places([(words, starts)]).find(keys, np.zeros(len(keys), np.int64))
        assert sorted(found.tolist()) == list(range(len(keys))) and (placed[found] == keys).all()
        other = np.setdiff1d(rng.integers(0, 1 << 48, 5000), keys)
        at = alignment.Places([(words, starts)]).find(other, np.zeros(len(other), np.int64))
        assert ((at < 0) | (placed[at] != other)).all() if n else (at < 0).all()
