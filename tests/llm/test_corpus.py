"""Operators for training corpora: brute force, round trips, edge cases."""

import collections
import hashlib
import itertools
import math
import pathlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from placehull.llm import chat, decontaminate, linededup, mixing, neardup, ngrams, quality, sitestyle, tokencount, warc, words
from placehull.llm.graph import components
from placehull.llm.queries import ORACLES, QUERIES
from placehull.session import stage

SMALL = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
ODD = "doc_id long, text string, source string, size long, hits string, kept string, n_cut string, n_chars long"


def odd_documents(spark, empty=False):
    """Nulls, empties, a long text, ties, equal rows and columns named like results."""
    long = " ".join(f"w{i % 977}x{i % 89}" for i in range(30_000))
    rows = [
        (1, None, "a", 1, "x", "y", "z", 0), (2, "", None, 1, "x", "y", "z", 0), (None, "one two three four five six", None, 1, "x", "y", "z", 0),
        (3, long, "a", 1, "x", "y", "z", 0), (3, long, "a", 1, "x", "y", "z", 0), (4, "one two three four five six", "b", 1, "x", "y", "z", 0),
        (5, " \t\n\x0b\f\r ", "b", 1, "x", "y", "z", 0), (6, "Short", "b", 1, "x", "y", "z", 0),
    ]
    return spark.createDataFrame([] if empty else rows, ODD)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    with duckdb.connect() as db:
        db.execute("set TimeZone='UTC'")
        for t in TABLES:
            db.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
        want = db.sql(ORACLES[name]).to_df()
    got = QUERIES[name](spark, SMALL).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    frame = lambda df: df[columns].sort_values(columns).reset_index(drop=True).astype(str)
    assert frame(got).equals(frame(want))


def test_mix_meets_targets_and_odd_rows(spark):
    rows = mixing.plan_mix(odd_documents(spark)).collect()
    assert len(rows) == 8 and all(r.copies <= 2 for r in rows)
    assert mixing.plan_mix(odd_documents(spark, True)).count() == 0
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('s', id % 3) as source", "'a b c d' as text")
    planned = mixing.plan_mix(docs).groupBy("source").agg({"target": "max", "copies": "sum"}).collect()
    for r in planned:
        assert r["sum(copies)"] * 4 == pytest.approx(r["max(target)"], rel=0.05)
    assert mixing.emit(mixing.plan_mix(docs)).count() == sum(r["sum(copies)"] for r in planned)


def test_quality_odd_rows(spark):
    scored = quality.score_quality(odd_documents(spark)).collect()
    assert len(scored) == 8 and not any(r.kept for r in scored if r.n_words < 50)
    assert quality.keep_good(odd_documents(spark, True)).columns == odd_documents(spark).columns


def test_quality_against_labels(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = QUERIES["op9_weak_supervision"](spark, SMALL).join(labels, "doc_id").filter("not base_failed").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) >= 0.98 * len(rows)


def cut_by_force(docs, least):
    """Lines in repeats of ``least`` words or more that stand earlier: every pair of positions is compared."""
    at = [(d, i, line) for d, text in sorted(docs) for i, line in enumerate(text.split("\n"))]
    gone = set()
    for q in range(len(at)):
        for p in range(q):
            n = 0
            while q + n < len(at) and at[q + n][0] == at[q][0] and at[p + n][0] == at[p][0] and at[p + n][2] == at[q + n][2]:
                n += 1
            if sum(len(at[q + k][2].split()) for k in range(n)) >= least:
                gone.update((at[q + k][0], at[q + k][1]) for k in range(n))
    return gone


def test_line_runs_equal_brute_force(spark):
    pool = ["a b c", "d e", "f", "g h i j k l m n", "o p q r", "s t"]
    docs = [(d, "\n".join(pool[(d * d * 7 + i * (d % 5 + 1)) % 6] if i % 4 else f"own {d} {i}" for i in range(12))) for d in range(25)]
    got = {r.doc_id: r.text for r in linededup.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 5).collect()}
    gone = cut_by_force(docs, 5)
    assert gone
    for d, text in docs:
        assert got[d] == "\n".join(x for i, x in enumerate(text.split("\n")) if (d, i) not in gone)


def test_line_runs_odd_rows(spark):
    rows = linededup.drop_repeats(odd_documents(spark), 4).orderBy("doc_id").collect()
    assert len(rows) == 8
    by = {r.doc_id: r for r in rows}
    assert by[1].text is None and by[4].n_cut == 0 and by[None].text == ""  # a null id comes last, so its line is the copy
    assert linededup.drop_repeats(odd_documents(spark, True)).count() == 0


def test_near_copies_odd_rows(spark):
    rows = neardup.group_copies(odd_documents(spark)).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert [r.kept for r in by[3]] == [True, True] and by[None][0].component_id == 4 and not by[None][0].kept
    assert by[1][0].n_shingles == 0 and by[6][0].n_shingles == 1 and by[2][0].kept
    kept = neardup.keep_one(odd_documents(spark))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 6] and kept.columns == odd_documents(spark).columns
    assert neardup.group_copies(odd_documents(spark, True)).count() == 0


def test_sketch_estimates_similarity():
    known = neardup.Hashes()
    base = [f"w{i}".encode() for i in range(600)]
    other = base[:540] + [f"v{i}".encode() for i in range(60)]
    a, b = (neardup.shingles(x, known) for x in (base, other))
    true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    x, y = (neardup.odd_sketch(neardup.minhash(s)).view("u1") for s in (a, b))
    flips = sum(int(v).bit_count() for v in x ^ y)
    k = neardup.ROWS * neardup.BANDS
    assert 1 + neardup.BITS / (4 * k) * math.log(1 - 2 * flips / neardup.BITS) == pytest.approx(true, abs=0.12)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_digests_tell_words_apart():
    """Equal digests are equal words, in any place of a text, short or longer than a piece."""
    dice = random.Random(3)
    huge = b"x" * (2 * words.PIECE + 7)
    kinds = [bytes(dice.choice(b"abAB\xc3\xa4\x00.") for _ in range(dice.randrange(1, 14))) for _ in range(3000)]
    kinds += [huge, huge + b"y", b"y" + huge, b"w" * words.PIECE, b"w" * (words.PIECE - 1)]
    text = b"".join(dice.choice(kinds) + dice.choice([b" ", b"\t\n", b"\x0b\x0c", b"\r "]) for _ in range(40_000))
    for t in (text, b" " + huge, huge.upper() + b"\n" + huge, b" " * 3 * words.PIECE + b"a", b"", b" \t\n\x0b\f\r", None):
        got, want = words.digests(t).tolist(), words.words_of(t)
        assert len(got) == len(want)
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_latent_space_is_fitted_on_all_passages(spark):
    """The space is that of a dense product over every passage of every document, and half of the benchmark's weight."""
    d, dice = decontaminate, random.Random(8)
    texts = [" ".join(f"t{i % 7}w{int(dice.paretovariate(0.7)) % 400}" for _ in range(dice.choice([5, 120, 300]))) for i in range(900)]
    items = [" ".join(f"b{i % 3}w{dice.randrange(50)}" for _ in range(40)) for i in range(30)]
    frame = lambda rows: spark.createDataFrame([(bytearray(t.encode()),) for t in rows], "text binary")
    read = d.passages(frame([*texts, ""]).repartition(5))
    counts, n = d.document_counts(read)
    hashed = [d.features(d.digests(t.encode())) for t in texts]
    assert n == 900
    assert (counts == sum(np.bincount(np.unique(h), minlength=d.FEATURES) for h in hashed)).all()
    idf = np.log((n + 1) / (counts + 1))
    rows = []
    for side in (hashed, [d.features(d.digests(t.encode())) for t in items]):
        parts = [h[a:b] for h in side for a, b in itertools.pairwise(d.cuts_of(len(h)).tolist())]
        assert sum(map(len, parts)) == sum(map(len, side))
        assert max(map(len, parts)) <= d.LONGEST
        for f in parts:
            x = np.bincount(f, minlength=d.FEATURES) * idf
            rows.append(x / max(np.linalg.norm(x), 1e-9) / math.sqrt(len(parts)))
    rows = np.stack(rows)
    basis = np.random.Generator(np.random.PCG64(6)).standard_normal((d.FEATURES, d.DIMS + d.SPARE), np.float32)
    for _ in range(2):
        basis, _, _ = np.linalg.svd(rows.T @ (rows @ basis), full_matrices=False)
    got = d.latent_space(d.weighted(read).unionByName(d.weighted(d.passages(frame(items)))), idf.astype(np.float32))
    seen = rows @ (basis[:, :8] * 1.0)
    mine = rows @ np.divide(got[:, :8], idf[:, None], where=idf[:, None] != 0, out=np.zeros((d.FEATURES, 8)))
    assert np.abs(np.abs(seen) - np.abs(mine)).max() < 1e-3 * np.abs(seen).max()


def test_decontamination(spark):
    leak = "the quick brown fox jumps over the lazy dog while seven wizards brew purple potions under green moons"
    loose = leak.replace("quick", "swift").replace("purple", "violet")
    noise = " ".join(f"n{i}" for i in range(300))
    docs = [(1, f"{noise} {leak} {noise}"), (2, noise), (3, None), (4, loose), (5, ""), (None, leak.upper())]
    docs = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, hits string")
    bench = spark.createDataFrame([(7, leak), (8, None), (9, "")], "item_id long, text string")
    hits = {r.doc_id: [h.item_id for h in r.hits] for r in decontaminate.with_hits(docs, bench).collect()}
    assert hits == {1: [7], 2: [], 3: [], 4: [7], 5: [], None: [7]}
    assert decontaminate.with_hits(docs.limit(0), bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == 6


def test_rewritten_passages_are_found(spark):
    """Passages with 10 to 40 % of their words replaced, inside other words, against every window's subsequence."""
    rng = random.Random(6)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    pool = " ".join(r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(60).collect()).split()
    docs, shares = [], {}
    for n, (_, text) in enumerate(bench * 5):
        words, share = text.split(), (0.1, 0.2, 0.3, 0.35, 0.4)[n % 5]
        for i in rng.sample(range(len(words) - 4), min(len(words) - 4, round(share * len(words)))):
            words[i] = rng.choice(pool)
        at = rng.randrange(len(pool) - 600)
        docs.append((n, " ".join([*pool[at : at + 300], *words, *pool[at + 300 : at + 600]])))
        shares[n] = share
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: {h.item_id for h in r.hits} for r in decontaminate.with_hits(table, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    caught = collections.Counter()
    for n, text in docs:
        item, passage = bench[n % len(bench)]
        words, whole = decontaminate._ints(passage.encode()), decontaminate._ints(text.encode())
        width = len(words) + 32
        if any(decontaminate.checked(words, words[-4:], whole[i : i + width]) for i in range(200, 400, 4)):
            caught[shares[n], item in got[n]] += 1
    for share in (0.1, 0.2, 0.3, 0.35, 0.4):
        found, lost = caught[share, True], caught[share, False]
        assert found + lost >= 10 and found >= 0.9 * (found + lost), (share, found, lost)


def test_windows_are_those_of_each_text_alone():
    """Texts searched together, of any lengths, get the hits that each gets alone, and no window reaches into the next text."""
    d, dice = decontaminate, random.Random(2)
    space = np.random.default_rng(5).standard_normal((d.FEATURES, d.DIMS), np.float32)
    leak = [f"leak{i}" for i in range(60)]
    texts = [[*(f"f{dice.randrange(10**6)}" for _ in range(n)), *leak[:m]] for n, m in ((0, 60), (5, 60), (300, 30), (0, 30), (17, 0), (64, 60), (1, 60))]
    texts[3] = leak[30:]  # with the end of the text before it, it would be the whole passage
    hashed = [d.digests(" ".join(t).encode()) for t in texts]
    item = d.digests(" ".join(leak).encode()).tolist()
    search = d.Search(space, [(9, item, item[-4:])])
    together = search.look(hashed)
    assert [[h["item_id"] for h in x] for x in together] == [[9], [9], [], [], [], [9], [9]]
    assert [[(h["share"], h["position"]) for h in x] for x in together] == [[(h["share"], h["position"]) for h in search.look([x])[0]] for x in hashed]


def test_short_items_and_long_texts(spark):
    leak = "the quick brown fox jumps over the lazy dog while seven wizards brew purple potions under green moons"
    filler = [f"n{i % 7919}" for i in range(3 * decontaminate.CHUNK)]
    cuts = [decontaminate.CHUNK - 9, 2 * decontaminate.CHUNK + 3, len(filler)]
    docs = [(k, " ".join([*filler[:c], leak, *filler[c:]])) for k, c in enumerate(cuts)]
    docs += [(10, "Yes"), (11, "yes it is so"), (12, "yes no"), (13, "no")]
    bench = spark.createDataFrame([(1, leak), (2, "yes"), (3, "yes no"), (4, "a b c d e f g")], "item_id long, text string")
    got = {r.doc_id: [h.item_id for h in r.hits] for r in decontaminate.with_hits(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {0: [1], 1: [1], 2: [1], 10: [2], 11: [], 12: [3], 13: []}


def test_ngram_scores_equal_brute_force(spark):
    path = f"{SMALL}/documents.parquet"
    docs = duckdb.sql(f"select doc_id, text from read_parquet('{path}')").fetchall()
    tokens = {d: [*WORDS.findall((t or "").encode().lower()), b"\n</text>"] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    one, two, start = collections.Counter(), collections.Counter(), collections.Counter()
    for d, ws in tokens.items():
        if not held[d]:
            one.update(ws)
            two.update(zip(ws, ws[1:]))
            start.update(ws[:-1])
    total, kinds = sum(one.values()), len(one)
    for r in QUERIES["op2_ngram_scores"](spark, SMALL).collect():
        ws, score = tokens[r.doc_id], 0.0
        for i, w in enumerate(ws):
            p = (one[w] + 1) / (total + kinds + 1)
            if i and (c := start[ws[i - 1]]):
                m = c**ngrams.POWER
                p = (two[ws[i - 1], w] + m * p) / (c + m)
            score += math.log10(p)
        base = sum(math.log10((one[w] + 1) / (total + kinds + 1)) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(one[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score, abs=0.016 * len(ws))


def test_third_order_scores_equal_brute_force(spark):
    docs = duckdb.sql(f"select doc_id, text from read_parquet('{SMALL}/documents.parquet')").fetchall()
    tokens = {d: [*WORDS.findall((t or "").encode().lower()), b"\n</text>"] for d, t in docs}
    grams = [collections.Counter() for _ in range(3)]
    starts = [collections.Counter() for _ in range(3)]
    for d, ws in tokens.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            for n in range(3):
                grams[n].update(tuple(ws[i : i + n + 1]) for i in range(len(ws) - n))
                starts[n].update(tuple(ws[i : i + n]) for i in range(len(ws) - n))
    total, kinds = sum(grams[0].values()), len(grams[0])
    for r in QUERIES["op2_ngram_scores"](spark, SMALL).collect():
        ws, score = tokens[r.doc_id], 0.0
        for i, w in enumerate(ws):
            p = (grams[0][(w,)] + 1) / (total + kinds + 1)
            for n in (1, 2):
                context = tuple(ws[i - n : i])
                if i >= n and (c := starts[n][context]):
                    p = (grams[n][(*context, w)] + c**ngrams.POWER * p) / (c + c**ngrams.POWER)
            score += math.log10(p)
        assert r.score_3 == pytest.approx(score, abs=0.032 * len(ws))


def test_ngram_odd_rows_and_third_order(spark):
    docs = odd_documents(spark).selectExpr("doc_id", "text", "doc_id = 4 as held_out")
    two, three = (ngrams.score_texts(docs, n).collect() for n in (2, 3))
    assert len(two) == len(three) == 8 and min(r.n_tokens for r in two) == 1
    assert sum(r.score for r in three) > sum(r.score for r in two)
    assert ngrams.score_texts(docs.limit(0)).count() == 0


def test_block_ngrams_equal_brute_force():
    """Distinct n-grams of a block with their training counts; each shard gets one range of contexts, and few bytes."""
    dice = random.Random(4)
    texts = [[f"w{int(dice.paretovariate(0.8)) % 5000}" for _ in range(dice.choice([0, 1, 2, 400]))] for _ in range(200)]
    held = [n % 7 == 2 for n in range(len(texts))]
    tokens = [np.append(words.digests(" ".join(t).encode()), ngrams.END) for t in texts]
    kinds, ranks = np.unique(np.concatenate(tokens), return_inverse=True)
    block = ngrams.Block(held, ngrams.pack(np.array([len(t) for t in tokens]), kinds, ranks.astype(np.uint32)))
    for order, (at, place, c, s, counts, shard) in enumerate(block.ngrams(3, 5, np.empty(0, np.uint64)), 2):
        want = collections.Counter()
        for t, h in zip(tokens, held):
            for i in range(len(t) - order + 1):
                want[tuple(t[i : i + order].tolist())] += not h
        whole = np.concatenate(tokens)
        got = {tuple(whole[i - order + 1 : i + 1].tolist()): n for i, n in zip(at, counts[place].tolist())}
        assert got == want and len(c) == len(want) == len(set(zip(c.tolist(), s.tolist())))
        assert (np.diff(shard.astype(int)) >= 0).all() and (np.diff(c.astype(object)) >= 0).all()
    steps = np.sort(np.random.default_rng(1).integers(0, 1 << 44, 9999, np.uint64))
    sent = ngrams.pack(steps, np.ones(9999, np.uint32))
    assert all((a == b).all() for a, b in zip(ngrams.unpack(sent, "u8", "u4"), (steps, np.ones(9999))))
    assert len(sent) < 6 * 9999


def test_a_staged_table_leaves_no_shuffle_files(spark):
    def files():
        folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {p for d in folders for p in pathlib.Path(d.getPath()).rglob("shuffle_*")}

    before, wait = files(), time.time() + 20
    out = stage(spark.range(20_000).repartition(7, "id").groupBy((F.col("id") % 100).alias("k")).count(), "counts")
    while files() - before and time.time() < wait:
        time.sleep(0.2)
    assert not files() - before
    assert out.count() == 100


def test_elias_fano_round_trip():
    import numpy as np

    for values in ([], [0], [5, 5, 9], [1 << 62, (1 << 63) + 3], list(range(0, 10**6, 977))):
        x = np.array(values, np.uint64)
        assert (ngrams.EliasFano.of(x).values() == x).all()


@pytest.mark.parametrize("text", ["", "\\", "\\.", "<|im_end|>\n", "</s>[INST] ok [/INST]", "a\0b", "<<|s>", "[[/INST]", "\\\\<s>"])
def test_escape_round_trip(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROLS)


def test_reply_trees(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 5.0), (1, 3, 1, "assistant", "bad", 1.0), (1, 4, 2, "user", "more", 0.0),
        (1, 5, 4, "assistant", "<|im_end|>\n", 1.0), (2, 1, 2, "a", "x", 0.0), (2, 2, 1, "b", "y", 0.0), (3, 1, 99, None, None, 0.0),
    ]
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    best = chat.format_trees(messages, 1)
    got = {r.tree: r for r in best.collect()}
    assert set(got) == {1, 3} and got[1].leaf == 5 and got[1].score == 6.0  # tree 2 is a cycle
    back = {r.conv_id: r for r in chat.read_back(best).collect()}
    said = "user\nq\nassistant\ngood\nuser\nmore\nassistant\n<|im_end|>\n\n"
    assert back[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and back[1].loss_chars == len("good<|im_end|>\n")
    assert {(r.tree, r.leaf) for r in chat.format_trees(messages).select("tree", "leaf").collect()} == {(1, 3), (1, 5), (3, 1)}
    assert chat.format_trees(messages.limit(0)).count() == 0


def test_a_null_tree_is_a_tree(spark):
    rows = [(None, 1, None, "user", "q"), (None, 2, 1, "assistant", "a"), (4, 1, None, "user", "x"), (4, None, 1, "user", "no id"), (None, 2, 1, "assistant", "a")]
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string").withColumn("score", F.lit(1.0))
    got = {r.tree: r.formatted for r in chat.format_trees(messages).collect()}
    assert got == {None: "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n", 4: "<|im_start|>user\nx<|im_end|>\n"}


def test_deep_paths_plan_no_more_scans(spark):
    """The plan of a chain of 1,000 messages reads no more tables than that of 10."""
    scans = {}
    for n in (10, 1000):
        messages = spark.range(n).selectExpr("7L as tree", "id as node", "if(id > 0, id - 1, null) as parent", "'user' as role", "string(id) as text", "1d as score")
        paths = chat.best_paths(messages)
        assert [r.pos for r in paths.orderBy("node").collect()] == list(range(n))
        scans[n] = paths._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert scans[10] == scans[1000] == 1


def test_main_text():
    page = (
        '<html><head><title>t</title><script>"</p>"</script></head><body><header>Top</header><nav><ul><li>menu</ul></nav><div class="cookieNotice">c</div>'
        '<article><header><h1>T&eacute;l</h1></header><p>One <b>bo</b>ld&nbsp;x<p>Two<br>three<div class="ad-slot">buy</div><section id="comments">nice</section></article>'
        "<aside>s</aside><form>f</form><footer>z</footer></body></html>"
    )
    assert sitestyle.main_text(page) == "Tél One bold x Two three"
    assert sitestyle.main_text("plain &lt; text") == "plain < text" and sitestyle.main_text(None) == ""


def test_site_furniture_goes_by_entropy(spark):
    box = '<div class="k1"><p>Same words on each page</p></div>'
    rows = [(i, f"http://h/{i}", f"<body>{box}<div class=k2><p>Story {i} tells {i * 7}</p></div></body>", "x") for i in range(20)]
    rows += [(90, None, None, "x"), (91, "http://one/", f"<body>{box}</body>", "x"), (91, "http://one/", f"<body>{box}</body>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = collections.defaultdict(list)
    for r in sitestyle.extract(pages).collect():
        got[r.page_id].append(r.text)
    assert got[3] == ["Story 3 tells 21"] and got[90] == [""] and got[91] == ["Same words on each page"] * 2
    assert sitestyle.extract(pages.limit(0)).count() == 0


def tree_by_force(pages):
    """Importance of each node of a host's merged tree, from all pages' elements."""
    seen = collections.defaultdict(lambda: collections.defaultdict(list))
    for host, html in pages:
        merged = collections.defaultdict(lambda: ([], []))
        for e in sitestyle.parse(html)[1]:
            merged[e.path][0].append(tuple(e.children))
            merged[e.path][1].append((e.texts.hash, e.texts.factor))
        for path, (shape, texts) in merged.items():
            seen[host, path]["p"].append(tuple(shape))
            seen[host, path]["c"].append(tuple(texts))
    out = {}
    for key, kinds in seen.items():
        m = len(kinds["p"])
        scaled = [1.0 if m < 2 else -sum(n / m * math.log(n / m) for n in collections.Counter(v).values()) / math.log(m) for v in (kinds["p"], kinds["c"])]
        out[key] = m, 0.1 * scaled[0] + 0.9 * scaled[1]
    return out


def test_style_tree_equals_brute_force(spark):
    rows = [(f"http://h{i % 3}/", f"<body><nav>menu</nav><div class=a><p>{i}</p><p>x</p></div><div class=b>{'y' * (i % 2)}</div><ul>{'<li>z' * (i % 4)}</ul>") for i in range(40)]
    found = sitestyle.style_tree(spark.createDataFrame(rows, "host string, html string")).collect()
    want = tree_by_force(rows)
    assert {(r.host, r.node): (r.pages, pytest.approx(r.importance, abs=1e-9)) for r in found} == want


def test_the_tree_decides_inside_articles(spark):
    """Furniture in articles goes by entropy alone; without the tree the texts differ."""
    box = '<div class="k9"><p>Read more of our stories</p></div>'
    html = [f"<body><article><h1>Title {i}</h1><p>Story {i} tells {i * 7}</p>{box}<div class='related-work'><p>Work {i}</p></div></article></body>" for i in range(20)]
    copied = f"<body><div><article><p>All pages tell the same</p>{box}</article></div></body>"
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(html)] + [(50 + i, f"http://copies/{i}", copied) for i in range(20)]
    got = {r.page_id: r.text for r in sitestyle.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title 3 Story 3 tells 21 Work 3" and got[53] == "All pages tell the same Read more of our stories"
    assert sitestyle.main_text(html[3]) == "Title 3 Story 3 tells 21 Read more of our stories Work 3"


def test_names_inside_articles():
    page = (
        '<article><p>a</p><div class="search-theory"><p>b</p></div><div class="related-work"><p>c</p></div><div class="ad-slot">x</div>'
        '<div class="social share">y</div><p class="social-history">e</p><p>f</p></article>'
    )
    assert sitestyle.main_text(page) == "a b c e f"


@pytest.mark.parametrize("page", ["<a " * 20_000, "<script " * 20_000, "<! " * 20_000, "<a \"" * 20_001, "<div>" * 100_000, "<div>x" * 30_000, "<!--" * 20_000, "</p>" * 50_000])
def test_broken_and_deep_pages_take_linear_time(page):
    import resource

    started, before = time.process_time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    sitestyle.main_text(page)
    assert time.process_time() - started < 8 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000


def test_token_counts_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = tokencount.load_pieces(tokencount.VOCABULARY)
    exact = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="first", split=True)
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    texts += ["  a  b\n\n c", "<s>hi</s>", "日本語 😀😀 x", "\x00a\tb", "▁a ▁▁b", "\n", "  ", "<0x0A>x\n<0x0A>", "", None]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    for r in tokencount.count_tokens(docs, pieces).collect():
        assert r.n_tokens == len(exact.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)


def test_warc_records_read_back(spark):
    rows = [(1, "http://h/a", "<title>T</title><p>One <b>two</b><p>three &amp; four<script>x</script>"), (2, None, None), (2, None, None)]
    found = warc.derivatives(warc.responses_of(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert len(found) == 6 and len({r.record_id for r in found}) == 4
    for r in found:
        headers, block = warc.parse_record(bytes(r.record))
        assert headers["WARC-Refers-To"] == r.refers_to and headers["WARC-Block-Digest"] == r.block_digest == warc.digest_of(block)
        if r.record_type == "conversion" and r.target_uri:
            assert block.decode() == "T\nOne two\nthree & four\n"


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = corpus_pipeline.run(spark, SMALL)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "mix"]
    assert set(docs.columns) < set(rows.columns) and rows.count() > 0
    assert rows.join(docs, "doc_id", "left_anti").count() == 0
