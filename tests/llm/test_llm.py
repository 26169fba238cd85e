"""Operators against brute force on small tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from isoterra.llm import ann, lattice, mixing, ngram_join, packing, private, quality, repeats, shared, token_files, toxicity, training, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, score double, size long, key long, n long"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, f"s{(i or 0) % 3}"), len(t or ""), "x", 1.0, 7, 9, 3) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    passage = prose(rng, 45)
    texts = [(i, prose(rng, rng.randint(1, 120))) for i in range(60)]
    base = prose(rng, 150).split(" ")
    for i in range(60, 90):  # near copies of one text
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        texts.append((i, " ".join(w)))
    texts += [(90 + i, prose(rng, 20) + " \t" + passage + "\n" + prose(rng, 15)) for i in range(12)]
    texts += [(110, None), (111, ""), (112, "  \n"), (113, "One two"), (114, "one TWO"), (115, passage + " " + passage), (116, "w " * 400), (117, prose(rng, 9000)), (118, texts[5][1]), (119, texts[5][1])]
    texts += [(None, "no id here " + passage), (5, texts[5][1])]
    return texts


def word_list(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def test_word_hashes_tell_words_and_case():
    c = next(words.chunks(pa.array(["a b  a", None, "", "ab", "A é a"])))
    h = c.word.tolist()
    assert c.at.tolist() == [0, 3, 3, 3, 4, 7] and h[0] == h[2] != h[1] and h[4] != h[0] and len(set(h)) == 5
    low = next(words.chunks(pa.array(["A É b", "a é B"]), lower=True)).word.tolist()
    assert low[0] == low[3] and low[2] == low[5] and low[1] != low[4]


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (7, 7), (8, 9)], "a long, b long")
    assert {tuple(r) for r in shared.components(e).collect()} == {(5, 1), (4, 1), (3, 1), (1, 1), (9, 8), (8, 8)}
    assert shared.components(e.where("false")).count() == 0


@pytest.mark.parametrize("num,k,chunk", [(85, 4, 1500), (80, 5, 7)])
def test_ngram_join_is_brute_force(spark, corpus, num, k, chunk, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "HOT", 0.05)
    got = ngram_join.ngram_jaccard_components(docs_of(spark, corpus), num, 100, k).collect()
    sets = {}
    for i, t in corpus:
        w = word_list(t.lower() if t else t)
        sets.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    root = {i: i for i in sets if i is not None}
    flat = [(i, s) for i, ss in sets.items() if i is not None for s in ss if s]
    changed = True
    while changed:
        changed = False
        for i, a in flat:
            for j, b in flat:
                if root[i] < root[j] and 100 * len(a & b) >= num * len(a | b):
                    root[j], changed = root[i], True
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(((i, root.get(i)) for i, _ in corpus), key=str)
    assert {(r.doc_id, r.n_shingles) for r in got} == {(i, len(s)) for i, ss in sets.items() for s in ss}
    left = ngram_join.keep_one(docs_of(spark, corpus), num, 100, k)
    assert left.columns == DOCS.replace(",", "").split()[::2]
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted([str(i) for i, r in root.items() if i == r] + ["None"])


def test_group_keys_keep_a_group_of_linked_sets():
    rng = np.random.default_rng(1)
    for n in (7, 20, 130, 700):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        cut = max(1, int(len(a) * 0.07))
        b = np.unique(np.concatenate([a[cut:], rng.integers(0, 1 << 63, cut, dtype=np.uint64)]))
        if not ngram_join.linked(a, b, 85, 100):
            continue
        keys = [set(np.concatenate([ngram_join.group_keys(x, at, *ngram_join.scheme(at, 85, 100)[1:], 0, True)[0] for at in {ngram_join._size_class(len(a)), ngram_join._size_class(len(b))}]).tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


@pytest.mark.parametrize("window", [35, 12])
def test_repeats_are_brute_force(spark, corpus, window):
    got = {}
    for r in repeats.remove_repeats(docs_of(spark, corpus), window).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept))
    lists = [(i, word_list(t)) for i, t in corpus]
    seen = {}
    for _, w in lists:
        for j in range(len(w) - window + 1):
            seen[tuple(w[j : j + window])] = seen.get(tuple(w[j : j + window]), 0) + 1
    want = {}
    for i, w in lists:
        gone = {x for j in range(len(w) - window + 1) if seen[tuple(w[j : j + window])] > 1 for x in range(j, j + window)}
        want.setdefault(i, []).append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_windows_take_little_memory():
    """Windows are many times their text: columns that have been read go before the next ones are made."""
    import tracemalloc

    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 100_000, 900).tolist())) for _ in range(2000)]
    rows = pa.record_batch([pa.array(np.arange(2000)), pa.array(texts)], ["row", "text"])
    sent = None
    for f, most in ((repeats._confirm_batches(35, np.zeros(0, np.uint64)), 75), (repeats._meet_batches, 55)):
        tracemalloc.start()
        sent = list(f(iter([rows] if sent is None else sent)))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak / 1.73e6 < most  # bytes a window


def test_repeats_with_hot_anchors_and_false_proposals(spark, corpus, monkeypatch):
    want = sorted(map(str, repeats.remove_repeats(docs_of(spark, corpus), 12).collect()))
    monkeypatch.setattr(repeats, "LEAST", 3)  # what a few documents share travels window by window
    assert len(repeats._hot_anchors(docs_of(spark, corpus).select("text"), 12))
    assert sorted(map(str, repeats.remove_repeats(docs_of(spark, corpus), 12).collect())) == want
    # a place that holds other words is proposed: the automaton finds nothing of it
    text = " ".join(str(i) for i in range(30))
    rows = pa.record_batch([pa.array([1, 2]), pa.array([7, 8]), pa.array([text, "x " * 5]), pa.array([[{"passage": b"a b c d e f g h i j k l", "crow": 9, "cat": 3, "sure": False}, {"passage": text.encode(), "crow": 7, "cat": 0, "sure": False}], None])], ["doc_id", "row", "text", "passages"])
    out = pa.Table.from_batches(repeats._remove_batches(12)(iter([rows])))
    assert out.column("n_removed").to_pylist() == [0, 0] and out.column("kept").to_pylist()[0] == text


def test_targets_and_quotas():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 1.5, 2) == [200, 500 / 3, 250 / 3]
    assert mixing.targets([], [], 1.5, 2) == [] and mixing.targets([0, 10], [5, 2], 1.5, 2) == [0, 15]
    q = mixing.split_quotas([1000, 7, 0, 50], 8, 3)
    assert q.sum(1).tolist() == [1000, 7, 0, 50] and max(q.sum(0)) - min(q.sum(0)) <= 8 and (q >= 0).all()


def test_mixing(spark, corpus):
    d = docs_of(spark, corpus, {110: None, 111: None, 117: None})
    out = mixing.mix_sources(d).collect()
    assert [(r.doc_id, r.taken) for r in sorted(out, key=str)] == [(r.doc_id, r.taken) for r in sorted(mixing.mix_sources(d).collect(), key=str)]
    assert len(out) == len(corpus) and all(0 <= r.taken <= 2 * r.size for r in out)
    for s in {r.source for r in out}:
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and sum(r.size for r in own) == own[0].source_size
    runs = [(r.doc_id, p.turn, p.start, p.words) for r in out if r.doc_id == 117 for p in r.pieces]
    for turn in {x[1] for x in runs}:  # disjoint within a pass
        ends = sorted((s, s + w) for _, t, s, w in runs if t == turn)
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    rows = mixing.mixed_rows(d)
    assert rows.columns == d.columns and sum(len(word_list(r.text)) for r in rows.collect()) == sum(r.taken for r in out)
    assert mixing.mix_sources(d.where("false")).count() == 0


def test_mixing_is_the_tree_s_quotas_word_for_word(spark, corpus):
    rows = [(i, t) for i, t in corpus if i is not None]
    out = mixing.mix_sources(docs_of(spark, rows, {110: None}), shards=4, seed=5).collect()
    by_source = {}
    for r in out:
        by_source.setdefault(r.source, []).append(r)
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    blocks = []
    for s in order:
        n, target = by_source[s][0].source_size, by_source[s][0].target
        want, whole = round(target), -(-n // mixing.BLOCK)
        seen = {}
        for r in by_source[s]:
            spans = {}
            for p in r.pieces:
                assert 0 <= p.start and p.start + p.words <= r.size and p.words > 0
                spans.setdefault(p.turn, []).append((p.start, p.start + p.words))
                seen.setdefault((p.turn, p.place), set()).add(p.shard)
            for turn, x in spans.items():
                x.sort()
                assert all(a[1] <= b[0] for a, b in zip(x, x[1:]))
                if turn < want // max(n, 1):  # a whole pass takes every word
                    assert sum(z - a for a, z in x) == r.size
            assert r.taken == sum(z - a for x in spans.values() for a, z in x)
        assert abs(sum(r.taken for r in by_source[s]) - target) <= 1
        assert all(len(x) == 1 for x in seen.values())  # a block goes to one shard
        blocks.append([sum(x == {shard} for x in seen.values()) for shard in range(4)])
        assert whole * (want // max(n, 1)) <= len(seen) <= whole * (want // max(n, 1) + 1)
    assert np.array(blocks).tolist() == mixing.split_quotas([sum(b) for b in blocks], 4, 5).tolist()


def test_columns_with_clashing_names_keep_their_values(spark):
    kind = "doc_id long, text string, source string, n_chars long, size long, base string, terms string, pieces int, _key int, _no int, row int, turn int, `a.b` int, taken string"
    rows = [(i, f"w{i} mail me@self.org and more words of it {i}", "s", 1, 7, "b", "t", 3, 4, 5, 6, 8, 9, "x") for i in range(6)] + [(9, None, None, *[None] * 11)]
    d = spark.createDataFrame(rows, kind)
    others = [c for c in d.columns if c not in ("text", "n_chars")]
    for f in (private.sanitise, mixing.mixed_rows, ngram_join.keep_one):
        out = f(d)
        assert out.columns == d.columns
        for r in out.collect():
            assert r.doc_id == 9 or [r[c] for c in others] == [dict(zip(d.columns, rows[r.doc_id], strict=True))[c] for c in others]
    mixed = mixing.mix_sources(d)
    assert mixed.columns == [*(c for c in d.columns if c not in mixing.ADDED), *mixing.ADDED] and mixed.count() == 7
    assert private.find_private(d).columns == [*(c for c in d.columns if c not in ("base", "terms")), "base", "terms"]


def test_private_repeated_rows_count_each(spark):
    rows = [(1, "Quixotic Zanzibar mail me@self.org"), (1, "Quixotic Zanzibar mail me@self.org"), (2, "nothing here"), (3, None)]
    got = [r.spans for r in private.digests(private.find_private(docs_of(spark, rows))).collect() if r.doc_id == 1]
    assert got == ["term:0:8,term:9:17,term:18:22,email:23:34"] * 2


def test_tokens_round_trip(spark, corpus):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    rows = [(i, (t or "") + " Straße, it's 3 x!! DÉJÀ-vu <|endoftext|> İ ΑΣ" if i and i % 4 == 0 else t) for i, t in corpus]
    m = token_files.write_tokens(docs_of(spark, rows), path, 2, token_files.token_folder(spark))
    got = sorted((r.start, r.n_tokens, r.ids_crc32, r.doc_id) for r in token_files.read_tokens(m).collect())
    t, start, want = Tokenizer.from_file(path), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), i))
        start += len(ids)
    assert got == want
    assert token_files.read_tokens(token_files.write_tokens(docs_of(spark, rows).where("false"), path, 2, token_files.token_folder(spark))).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(s))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            g = re.sub("[^0-9]", "", m.group())
            if {"email": lambda: True, "ip": lambda: all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")), "card": lambda: 12 <= len(g) <= 19 and luhn(g), "phone": lambda: 9 <= len(g) <= 15}[kind]():
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_private_base_is_the_patterns(spark):
    rng = random.Random(5)
    parts = ["a.b@x-y.com", "x@y", "a@b.c@d.e", "x@y.z_w@v.u.", "10.0.0.1", "1.2.3.4.5.6.7.8", "256.1.1.1", "000010.1.2.3", "4111 1111-1111 1111", "4111111111111112", "1" * 2000, "+49 (30) 123.456-7", "+1+2345678901", "é😀", "  ", "-", ".", "5500 0000 0000 0004", "+1 (830) 555-5433", "@@", "word" * 3]
    texts = [(i, "".join(rng.choice(parts) + rng.choice([" ", "", ", "]) for _ in range(rng.randint(1, 9)))) for i in range(120)] + [(200, None), (201, ""), (None, "a@b.cc")]
    got = private.digests(private.find_private(docs_of(spark, texts))).collect()
    assert len(got) == len(texts)
    want = sorted((str(i), hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest()) for i, t in texts)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want


def test_private_terms_disclose_and_clean_texts_stay(spark):
    rng = random.Random(6)
    texts = [(i, prose(rng, 30)) for i in range(40)]
    texts += [(40 + i, f"{prose(rng, 10)} Zanzibarian mail me@self.org of the abcd {prose(rng, 10)}") for i in range(3)]
    d = docs_of(spark, texts)
    out = {r.doc_id: r.text for r in private.sanitise(d).collect()}
    assert all(out[i] == t for i, t in texts[:40])
    assert all("<TERM> <TERM> <EMAIL> of the" in out[40 + i] for i in range(3))
    assert private.sanitise(d.where("false")).count() == 0 and private.sanitise(d).columns == d.columns


def test_private_terms_are_whole_documents(spark):
    rng = random.Random(9)
    far = lambda: ". ".join(prose(rng, 12) for _ in range(8))
    texts = [(i, prose(rng, 60)) for i in range(40)]
    texts += [(40 + i, f"Quixotically {far()} ask me@self.org or {'éé' * 2}me@self.org. {far()}\n\nthe QUIXOTICALLY man, {far()} quixotically") for i in range(3)]
    texts += [(50, "quixotical Xquixotically me@self.orgé"), (51, None), (52, "you@else.org alone quixotic"), (43, texts[40][1])]
    got = {}
    for r in private.digests(private.find_private(docs_of(spark, texts))).collect():
        got.setdefault(r.doc_id, []).append([s for s in r.spans.split(",") if s.startswith("term")])
    n, docs = len(texts), [t or "" for _, t in texts]
    entities, terms, free = [], [], []
    for t in docs:
        spans = [s.split(":") for s in base_spans(t)]
        entities.append({(k, t[int(a) : int(z)]) for k, a, z in spans})
        words_ = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W\d_]{4,64}", t)]
        terms.append({w for *_, w in words_})
        free.append([x for x in words_ if not any(x[0] < int(z) and int(a) < x[1] for _, a, z in spans)])
    for i, (doc_id, _) in enumerate(texts):
        gone = set()
        for e in entities[i]:
            of_e = sum(e in x for x in entities)
            for w in {x[2] for x in free[i]}:
                of_w, of_both = sum(w in x for x in terms), sum(e in x and w in {y[2] for y in f} for x, f in zip(entities, free, strict=True))
                if of_both >= 2 and n > of_e and math.log2(n * of_both / (of_w * of_e)) >= 0.9 * math.log2(n / of_e):
                    gone.add(w)
        assert [f"term:{a}:{z}" for a, z, w in free[i] if w in gone] in got[doc_id], doc_id
    out = {r.doc_id: r.text for r in private.sanitise(docs_of(spark, texts)).collect()}
    assert all("quixotically" not in out[i].lower() and out[i].count("<TERM>") >= 3 for i in range(40, 43))


def test_packing(spark, corpus):
    out = packing.pack(docs_of(spark, corpus), (64, 128, 512)).collect()
    bins = {}
    for r in out:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
        else:
            assert r.piece_size == 0
    for rows in bins.values():
        rows.sort(key=lambda r: r.bin_offset)
        assert all(a.bin_offset + a.piece_size == b.bin_offset for a, b in zip(rows, rows[1:]))
        held, cap = rows[-1].bin_offset + rows[-1].piece_size, rows[0].capacity
        assert held <= cap and cap == min(c for c in (64, 128, 512) if c >= held)
    assert sum(r.piece_size for r in out) == sum(len(word_list(t)) for _, t in corpus)
    assert sum(r.piece_size for r in out) / sum(rows[0].capacity for rows in bins.values()) > 0.9
    assert packing.pack(docs_of(spark, corpus).where("false")).count() == 0


def test_packing_is_brute_force():
    rng = np.random.default_rng(3)
    for sizes in (rng.integers(1, 513, 300), np.full(40, 7), np.array([512, 1, 511]), np.array([], np.int64)):
        caps = (64, 128, 512)
        left = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
        bins, got = [], {}
        for k, i in enumerate(left):
            n = int(sizes[i])
            room = [(cap - fill, b) for b, (cap, fill) in enumerate(bins) if cap - fill >= n]
            if room:
                b = min(room)[1]
            else:
                after = [int(sizes[j]) for j in left[k + 1 :]]
                b = len(bins)
                bins.append([min((c for c in caps if c >= n), key=lambda c: packing.cost(c) / (n + min(c - n, sum(x for x in after if x <= c - n)))), 0])
            got[i] = (b, bins[b][1])
            bins[b][1] += n
        bin_of, offset, cap = packing.best_fit(np.asarray(sizes, np.int64), caps)
        assert [(int(b), int(o)) for b, o in zip(bin_of, offset)] == [got[i] for i in range(len(sizes))]
        assert [int(c) for c in cap] == [min(c for c in caps if c >= bins[b][1]) for b in bin_of.tolist()]


def labelled(spark, n=400):
    rng = random.Random(8)
    texts, labels = [], []
    for i in range(n):
        w, toxic, bad = prose(rng, rng.randint(60, 120)).split(" "), i % 4 == 0, i % 5 == 0
        if toxic:
            for _ in range(6):
                w[rng.randrange(len(w))] = rng.choice(["nastyword", "vileness", "horridly"])
        if bad:
            w = [x.upper() + "!!" for x in w]
        texts.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic), "x"))
    texts += [(n, None), (n + 1, ""), (None, "text"), (n + 2, "z" * 5000)]
    return docs_of(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_toxicity_and_quality_learn(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r for r in labels.collect()}
    for score, column, bar in ((toxicity.score_toxicity, "toxic", 0.5), (quality.score_quality, "quality", 0.3)):
        out = score(docs, labels).collect()
        assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= bar) for r in out)
        held = [r for r in out if r.held_out and r.doc_id in truth]
        assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
        assert sum(r.predicted == truth[r.doc_id][column] for r in held) / len(held) > 0.95
        assert len(score(docs, labels.where("false")).collect()) == len(out)
        assert score(docs.where("false"), labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 250 < kept.count() < 360


def test_dictionaries_are_of_whole_texts_and_tell_phrases_of_plain_words():
    rng = random.Random(12)
    plain = [prose(rng, 3) for _ in range(300)]
    texts = [" ".join(rng.choice(plain) for _ in range(150)) + " eventually whereupon" * 20 for _ in range(60)]
    phrase = "the quick of other"  # no word of it is toxic, their sequence is
    toxic = [" ".join(rng.choice(plain) for _ in range(40)) + f" {phrase} " + " ".join(rng.choice(plain) for _ in range(40)) for _ in range(200)]
    held = toxicity.dictionaries(toxic, texts)
    assert b"eventually" in held.parts[1] and b"quick of" in held.parts[0]
    far = [held.of(toxicity.Windows(next(toxicity._lowered(pa.array([t]))))).max() for t in (f"abc {phrase} def", plain[0])]
    assert far[0] >= 3 > far[1]


def test_windows_cover_every_word():
    texts = [None, "", "one", "one two three four", "a b c d e", "  x\n y ", "z" * 1000 + " end"]
    w = toxicity.Windows(next(toxicity._lowered(pa.array(texts))))
    got = {}
    for d, t in zip(w.doc.tolist(), w.texts(slice(None)), strict=True):
        got.setdefault(d, []).append(t.strip())
    assert got[2] == [b"one"] and got[3] == [b"one two three", b"three four"] and got[4] == [b"a b c", b"c d e"] and got[5] == [b"x  y"]
    assert set(got) == {2, 3, 4, 5, 6} and all(len(t) <= toxicity.LONG for t in got[6]) and got[6][-1].endswith(b"end") and sum(map(len, got[6])) >= 1000


def test_non_negative_risk_prior_and_chance():
    rng = np.random.default_rng(0)
    n = len(quality.TOP) * 2  # records whose first measure alone tells, 600 of 1000 good
    record = np.zeros((1000, quality.RECORD), np.uint8)
    fine = np.concatenate([rng.normal(3000, 200, 600), rng.normal(1200, 300, 400)]).astype("<u2")
    record[:, :2] = fine.view(np.uint8).reshape(-1, 2)
    cuts = [np.arange(500, 4000, 250), *[np.zeros(0)] * (n // 2 - 1)]
    x = quality.inputs(record, cuts).astype(float)
    p = x[rng.permutation(600)[:300]]

    def sums(w):
        z = x @ w
        s = 1 / (1 + np.exp(-z))
        return (x * (s * (1 - s))[:, None]).T @ x, x.T @ s, np.logaddexp(0, z).sum(), len(x)

    w = quality.fit_nnpu(p[:150], sums, 0.5, np.zeros(x.shape[1]))
    times = np.bincount(quality._bin(x @ w), minlength=quality.FINE)
    prior = quality.class_prior(p[150:] @ w, times)
    assert 0.55 < prior < 0.7
    w = quality.fit_nnpu(p[:150], sums, prior, w)
    negative = np.logaddexp(0, x @ w).mean() - prior * np.logaddexp(0, p[:150] @ w).mean()
    assert negative > -0.02  # the part that the correction keeps from falling below nothing
    scale, shift = quality.calibration(p[150:] @ w, np.bincount(quality._bin(x @ w), minlength=quality.FINE), prior)
    chance = 1 / (1 + np.exp(-(scale * (x @ w) + shift)))
    assert chance[:600].mean() > 0.85 and chance[600:].mean() < 0.2
    y = rng.normal(size=(300, 2))
    w, _ = training.logistic(y, (y[:, 0] > 0).astype(float))
    assert w[0] > 3 * abs(w[1])


def test_models_take_repeats_one_class_and_hard_rows(spark):
    docs, labels = labelled(spark, 200)
    twice = docs.union(docs.where("doc_id < 20"))
    for score, column in ((toxicity.score_toxicity, "toxic"), (quality.score_quality, "quality")):
        out = score(twice, labels.union(labels.where("doc_id < 9"))).collect()
        assert len(out) == twice.count() and len({(r.doc_id, r.score) for r in out if r.doc_id is not None}) == len({r.doc_id for r in out if r.doc_id is not None})
        one = score(docs, labels.where(f"{column} = 1")).collect()
        assert len(one) == docs.count() and all(0 <= r.score <= 1 for r in one)
        again = score(docs, labels.where(f"{column} = 1")).collect()
        assert sorted(one, key=str) == sorted(again, key=str)


def vectors_of(spark, x, first=0):
    rows = [(first + i, None if v is None else [None if c is None else float(c) for c in v], 1, 0.5, 3) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double, rank int")


ODD = [None, [], [0.0] * 16, [1.0] * 15 + [None], [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0]]


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16)) * rng.uniform(0.5, 2, (900, 1))
    x[7] = x[3]
    data = vectors_of(spark, [*x.astype(np.float32), *ODD])
    got = {}
    for r in ann.nearest(data, data.where("vec_id % 20 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = x.astype(np.float32).astype(np.float64)
    hit = 0
    for q in range(0, 900, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(900), -s))[:10]
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 11)) and all(math.isclose(r[2], s[r[1]], rel_tol=1e-12) for r in rows)
        hit += len({r[1] for r in rows} & set(best.tolist()))
    assert hit / 450 >= 0.9 and set(got) == set(range(0, 900, 20))
    few = data.where("vec_id < 4")
    assert ann.nearest(few, few.where("vec_id = 0"), 10).count() == 3
    assert ann.nearest(data.where("false"), data.where("false")).count() == 0


@pytest.mark.parametrize("norms", ["one", "long", "lognormal"])
def test_nearest_whatever_the_norms(spark, norms):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if norms == "long":
        x[17] *= 20
    elif norms == "lognormal":
        x *= np.exp(rng.normal(size=(6000, 1)) * 0.7)
    x = x.astype(np.float32).astype(np.float64)
    data = vectors_of(spark, x)
    got = {}
    for r in ann.nearest(data, data.where("vec_id % 60 = 0"), 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, 6000, 60):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hit / 2000 >= 0.94


def test_nearest_over_shards_blocks_and_magnitudes(spark, monkeypatch):
    for name, value in (("SHARD", 700), ("BLOCK", 5), ("LARGE", 16), ("WHOLE", 100)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(13)
    x = rng.normal(size=(2000, 16))
    x[500:520] *= 1e-30
    x[40] *= 1e40
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(data, data.where("vec_id % 40 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    for q in range(0, 2000, 40):
        s = x @ x[q]
        s[q] = -np.inf
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 11)) and all(math.isclose(r[2], s[r[1]], rel_tol=1e-9) for r in rows)
        hit += len({r[1] for r in rows} & set(np.argsort(-s)[:10].tolist()))
    assert hit / 500 >= 0.9
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, -1e300]), (2, [1.0, 1e-300]), (3, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in ann.nearest(huge, huge.where("vec_id = 0"), 3).orderBy("rank").collect()] == [(1, math.inf), (2, 1e300), (3, -math.inf)]


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 8)) * 2
    p = lattice.decode(x)
    assert len(lattice.ROOTS) == 240 and np.allclose((lattice.ROOTS**2).sum(1), 2)
    near = ((x[:, None] - (p[:, None] + lattice.ROOTS)) ** 2).sum(2).min(1)
    assert (((x - p) ** 2).sum(1) <= near + 1e-9).all()
    assert np.allclose((p * 2).round(), p * 2) and np.allclose(p.sum(1) % 2, 0)


def test_sketches_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(21)
    x = rng.normal(size=(20000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(1)[:, None] * x
    y = 0.9 * x + math.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1)[:, None]
    axes = rng.standard_normal((24, lattice.SKETCH))
    apart = ((x @ axes > 0) != (y @ axes > 0)).sum(1)
    angle = math.acos(0.9) / math.pi
    assert apart.max() <= lattice.SKETCH * angle + 6 * math.sqrt(lattice.SKETCH * angle * (1 - angle))


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    x[100:140] = x[10] + rng.normal(size=(40, 16)) * 0.12
    x[140:150] = x[20]
    x[150] = 3 * x[30]
    data = vectors_of(spark, [*x.astype(np.float32), *ODD])
    x = x.astype(np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    root = list(range(300))
    for _ in range(300):
        root = [min([root[i], *(root[j] for j in np.flatnonzero(link[i]))]) for i in range(300)]
    out = {r.vec_id: r for r in lattice.near_duplicates(data, 0.9).collect()}
    assert [out[i].n_links for i in range(300)] == link.sum(1).tolist()
    assert [out[i].component_id for i in range(300)] == root and all(r.kept == (r.vec_id == r.component_id) for r in out.values())
    assert all(out[i].n_links == 0 and out[i].component_id == i for i in range(300, 300 + len(ODD)))
    assert lattice.near_duplicates(data.where("false")).count() == 0


def test_pipeline_is_its_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        kept = shared.written(stage(spark, kept, "/root/testdata/sf0.001"), "test")
        assert kept.columns == docs.columns, name
    want = pipeline.STAGES[-1][1](spark, kept, "").collect()
    got = pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and got
    assert json.dumps([n for n, _ in pipeline.STAGES])


def test_near_copies_go_without_broadcasting_hash_tables(spark, capsys):
    from isoterra.llm import shared

    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "other words of no copy at all here"), (3, "other words of no copy at all here"), (None, text), (5, None)], "doc_id long, text string")
    kept = ngram_join.keep_one(docs)
    kept.explain()
    assert "Broadcast" not in capsys.readouterr().out
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 5]
    rows = spark.createDataFrame([(1,), (2,), (None,), (9,)], "a long")
    for ids, inside in (([2, 9], {2, 9}), ([], set())):
        held = np.array(ids, np.int64)
        assert {r.a for r in shared.among(rows, held, "a").collect()} == inside
        assert {r.a for r in shared.among(rows, held, "a", False).collect()} == {1, 2, None, 9} - inside


def test_windows_hold_every_vector_inside_and_places_are_bytes():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 16))
    index = ann.SortedProjections(x, float((x * x).sum(1).max()), 20)
    assert index.place.dtype == np.uint8  # a pass over all vectors for each projection reads one byte of each
    norm2 = float((x * x).sum(1).max())
    lift = np.sqrt(np.maximum(norm2 - (x * x).sum(1), 0))
    for q in rng.standard_normal((5, 16)):
        found, width = index.candidates(q, norm2, 20)
        at = q @ index.axes[:-1] * np.sqrt(norm2 / (q @ q))
        p = x @ index.axes[:-1] + lift[:, None] * index.axes[-1]
        inside = (np.abs(p - at) < width * 0.9999).sum(1) >= np.ceil(ann.COLLISIONS * ann.PROJECTIONS)
        assert set(np.flatnonzero(inside)) <= set(found.tolist()) and len(found) >= 20 + 0.1 * len(x)
