"""The training-data operators against brute force, on small and awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cellmend.llm import ann, bpe, chat, host_rules, license_scan, ngram_join, packing, quality_fm, substring, toxicity
from cellmend.llm.graph import components
from cellmend.llm.queries import vocabulary_path
from cellmend.llm.store import Workspace

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def prose(rnd, n, vocabulary=200):
    return " ".join(f"w{int(rnd.paretovariate(0.7)) % vocabulary}" for _ in range(n))


def awkward(spark):
    """Nulls, empty texts, repeated rows, near and exact copies, shared passages, an extra column."""
    rnd = random.Random(5)
    base = [prose(rnd, rnd.choice([1, 3, 5, 40, 120, 400])) for _ in range(60)]
    rows = [(i, t, "s") for i, t in enumerate(base)]
    passage = prose(rnd, 60)
    for i in range(60, 90):
        w = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            w[rnd.randrange(len(w))] = f"edit{rnd.randrange(1000)}"
        rows.append((i, " ".join(w), None))
    for i in range(90, 100):
        rows.append((i, prose(rnd, 20) + "\n" + passage + "\t" + prose(rnd, 20), "s"))
    rows += [(100, None, "s"), (101, "", "s"), (102, " \n\t ", None), (103, "Ünï cödé   x", "s"), (0, base[0], "s"), (104, "a " * 300, "s"), (105, "A b C d e", "s"), (106, "a B c D E", "s")]
    return spark.createDataFrame([(d, t, s, 7) for d, t, s in rows], "doc_id long, text string, source string, n int").repartition(5)


def words(text):
    return WORDS.findall((text or "").encode())


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark).cache()


@pytest.mark.parametrize(("k", "pct", "hot"), [(4, 85, 512), (5, 80, 512), (1, 60, 512), (1, 60, 2)])
def test_jaccard_join_equals_brute_force(docs, monkeypatch, k, pct, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    if hot == 2:  # all but one comparison of a signature is left to the last round, in many shares
        monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 1)
    sets = defaultdict(set)
    for r in docs.collect():
        w = [x.lower() for x in words(r["text"])]
        sets[r["doc_id"]] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= pct * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = ngram_join.jaccard_join(docs, k, pct).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {d: (len(s), find(d)) for d, s in sets.items()}


def test_signatures_of_similar_sets_meet():
    rnd = np.random.default_rng(2)
    limits = ngram_join.bands(3000, 85)
    counts = [(b, 5000) for b in range(len(limits))]
    limits, instances = ngram_join.plan(counts, 85)
    for size in (1, 6, 13, 60, 147, 400, 1500):
        for _ in range(20):
            a = np.unique(rnd.integers(0, 1 << 63, size).astype(np.uint64))
            drop, add = (rnd.integers(0, max(1, int(size * 0.16))) for _ in range(2))
            b = np.unique(np.concatenate((a[drop:], rnd.integers(0, 1 << 63, add).astype(np.uint64))))
            common = len(np.intersect1d(a, b))
            if len(b) and 100 * common >= 85 * (len(a) + len(b) - common):
                sig, who = ngram_join.signatures([a, b], limits, instances)
                assert np.intersect1d(sig[who == 0], sig[who == 1]).size, size


def test_rows_of_one_doc_id_with_other_texts(spark):
    """Each row is compared by its own text, and the pipeline drops near copies row by row."""
    import corpus_pipeline

    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcd"}
    near = lambda c: text[c] + " edit"
    rows = [(1, text["a"]), (1, text["b"]), (2, near("b")), (2, text["c"]), (3, near("a")), (3, text["d"]), (4, near("c")), (4, near("d")), (5, text["a"]), (6, None), (7, near("d") + " too"), (8, text["c"] + " last"), (8, text["c"].upper() + " last")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    links = ngram_join.jaccard_join(df, 5, 80).where("n_shingles > 0").collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in links) == Counter([(1, 1), (1, 1), (2, 1), (2, 2), (3, 1), (3, 3), (4, 2), (4, 3), (5, 1), (7, 3), (8, 2), (8, 2)])
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, text["a"]), (1, text["b"]), (2, text["c"]), (3, text["d"]), (6, None)], key=str)
    own = spark.createDataFrame([(1, text["a"]), (1, near("a")), (1, text["a"])], "doc_id long, text string")
    assert corpus_pipeline.drop_near_duplicates(spark, own, "").count() == 1


def test_jaccard_join_of_empty_tables(spark, docs):
    assert ngram_join.jaccard_join(docs.limit(0)).count() == 0
    only = spark.createDataFrame([(1, None), (None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_join(only).collect()}
    assert got == {1: 1, None: 3, 3: 3}


@pytest.mark.parametrize("block", [4, 1000])
def test_components_of_a_long_chain(spark, block):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges, Workspace(spark, "test"), block=block).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


@pytest.mark.parametrize("block", [16, 1000])
def test_components_equal_a_plain_search(spark, block):
    rnd = random.Random(3)
    edges = [(rnd.randrange(-60, 60), rnd.randrange(-60, 60)) for _ in range(50)]
    want = {n: n for e in edges for n in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    table = spark.createDataFrame(edges * 2, "a long, b long")
    got = {r["node"]: r["root"] for r in components(table, Workspace(spark, "test"), block=block).collect()}
    assert got == {n: r for n, r in want.items() if n != r}


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "test")).count() == 0


def test_substring_dedup_equals_brute_force(docs):
    for window in (35, 5):
        rows = docs.collect()
        seen = Counter(tuple(w[i : i + window]) for r in rows for w in [words(r["text"])] for i in range(len(w) - window + 1))
        want = []
        for r in rows:
            w = words(r["text"])
            gone = [False] * len(w)
            for i in range(len(w) - window + 1):
                if seen[tuple(w[i : i + window])] > 1:
                    gone[i : i + window] = [True] * window
            want.append((r["doc_id"], len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
        got = [tuple(r) for r in substring.digests(docs, window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert substring.digests(docs.limit(0)).count() == 0


def test_remove_repeats_keeps_other_columns_and_texts(docs):
    out = {r["doc_id"]: r for r in substring.remove_repeats(docs, 35).collect()}
    assert set(docs.columns) | {"n_removed"} == set(out[1].__fields__) and out[100]["text"] is None and out[103]["text"] == "Ünï cödé   x"
    assert all(out[i]["n_removed"] >= 60 and out[i]["n"] == 7 for i in range(90, 100))


def test_index_levels_find_what_occurs_again(spark):
    index = substring.FingerprintIndex(spark, Workspace(spark, "index").path, 2)
    found = []
    for batch in ([1, 2, 3], [4, 5, 1], [6, 6, 2], [9, 4, 6], [3]):
        found.append({r["h"] for r in index.add(spark.createDataFrame([(x,) for x in batch], "h long")).collect()})
    assert found == [set(), {1}, {6, 2}, {4, 6}, {3}]
    index.close()


def test_history_deduplicates_batch_after_batch(spark, tmp_path):
    """Each batch against plain Python over it and all before it; the folder is opened anew for each."""
    rnd, w, path = random.Random(9), 12, str(tmp_path / "history")
    shared = [prose(rnd, 30, 5000) for _ in range(6)]
    batches, number = [], 0
    for b in range(4):
        rows = []
        for _ in range(12):
            rows.append((number, " ".join((prose(rnd, rnd.choice([2, 15, 30]), 5000), rnd.choice(shared), prose(rnd, 9, 5000), rnd.choice(shared + [""])))))
            number += 1
        batches.append(rows + [(number, None), (number + 1, " "), (number + 2, "one two")] + (batches[0][:2] if b == 2 else []))
        number += 3
    batches.insert(2, [])
    before, n_runs = Counter(), []
    for rows in batches:
        history = substring.History(spark, path, w, buckets=2, fanout=2)
        got = Counter(map(tuple, substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), w, history).select("doc_id", "n_removed").collect()))
        seen = before + Counter(tuple(words(t)[i : i + w]) for _, t in rows for i in range(len(words(t)) - w + 1))
        want = Counter()
        for d, t in rows:
            x = words(t)
            want[d, len({j for i in range(len(x) - w + 1) if seen[tuple(x[i : i + w])] > 1 for j in range(i, i + w)})] += 1
        assert got == want
        before = seen
        n_runs.append(sum(map(len, history.index.levels)))
        assert sorted(p.name for p in (tmp_path / "history").glob("run_*")) == sorted(r for level in history.index.levels for r in level)
        history.close()
    assert max(n_runs) < 4 * len(batches) - 4 and not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]
    # a batch that fails leaves no trace in the state
    history = substring.History(spark, path, w)
    state = (history.number, history.batches, [list(level) for level in history.index.levels])
    history.index.add(spark.createDataFrame([(1,)], "h long")).count()
    history.close()
    history = substring.History(spark, path, w)
    assert (history.number, history.batches, history.index.levels) == state
    history.close()
    with pytest.raises(ValueError):
        substring.History(spark, path, w + 1)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


HARD = ["'s", "'ll", " 're", "''s", " ", "  ", "\n", "\t", " ", "bc", "The", "12", "١", "!", "..", "é", "日本", "😀", "<|endoftext|>", "<|endof", "\x1c", "\x85", "aaaaaaa", "l'l", "́", "_", "\r\n", "½"]


def test_bpe_equals_the_library(spark, docs, tokenizer):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(HARD) for _ in range(rnd.randint(0, 14))) for _ in range(800)]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    tokens = bpe.encode(more, vocabulary_path())
    text = {r["doc_id"]: r["text"] or "" for r in more.collect()}
    got = {r["doc_id"]: r["ids"] for r in tokens.collect()}
    assert got == {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in text.items()}
    assert {r["doc_id"]: r["text"] for r in bpe.decode(tokens, vocabulary_path()).collect()} == text
    row = {r["doc_id"]: r for r in bpe.digests(more, vocabulary_path()).collect()}
    assert all(row[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() and row[d]["n_tokens"] == len(got[d]) for d, t in text.items())


def test_packing_is_whole_and_gapless(docs, tokenizer):
    for capacity in (64, 2048):
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in packing.pack(docs.dropDuplicates(["doc_id"]), vocabulary_path(), capacity, 1).collect():
            pieces[r["doc_id"]].append(r)
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for r in docs.dropDuplicates(["doc_id"]).collect():
            ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
            at = 0
            for p in sorted(pieces[r["doc_id"]], key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids)
                at += p["length"]
                assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : at], "<u4").tobytes())
            assert at == len(ids)
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at == capacity or at & (at - 1) == 0 and at < capacity


def test_sum_of_squares_choice():
    bins = packing.SumOfSquares(10)
    assert bins.place("a", 6) is None and bins.place("b", 6) is None and bins.count[6] == 2
    assert [p for p, _ in bins.place("c", 4)] == ["b", "c"] and bins.count[6] == 1
    assert bins.place("d", 3) is None and sum(bins.count) == 1 and bins.count[9] == 1


def test_packing_places_like_a_plain_sum_of_squares():
    """Each placement is that of the rule computed from scratch; most tokens stay where it put them."""
    rnd = random.Random(12)
    sizes = [rnd.choice([rnd.randint(1, 63), rnd.randint(1, 200)]) for _ in range(400)]
    packer, levels, plain = packing.Packer(64), [], packing.SumOfSquares(64)
    for size in (s % 64 for s in sizes):
        if not size:
            continue
        options = []
        for h in {0, *levels}:
            if h + size <= 64:
                after = list(levels)
                if h:
                    after.remove(h)
                if h + size < 64:
                    after.append(h + size)
                options.append((sum(n * n for n in Counter(after).values()), -h, after))
        _, _, levels = min(options)
        plain.place("x", size)
        assert Counter(levels) == {h: n for h, n in enumerate(plain.count.tolist()) if n}
    pieces = [p for i, s in enumerate(sizes) for p in packer.add(i, s)] + packer.finish()
    assert sum(p[2] for p in pieces) == sum(sizes) and packer.placed + packer.moved == sum(s % 64 for s in sizes)
    assert packer.placed > 0.9 * (packer.placed + packer.moved)
    whole = Counter()
    for doc, start, length, _, _ in pieces:
        whole[doc] += length
    assert whole == Counter(dict(enumerate(sizes)))


def test_licences(spark):
    mit = license_scan.TEMPLATES["MIT"][2]
    rows = [(0, "some words\nReleased under the MIT License.\nmore"), (1, None), (2, ""), (3, mit.replace("Software", "software").replace(". ", ".\n")), (4, "all of the words and the others"), (5, "x\n\nLicensed under CC BY-NC 4.0\n\nThis work is licensed under the GNU General Public License, version 3."), (6, "License")]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[0]["license"], got[0]["unit"], got[0]["score"]) == ("MIT", "line", 1.0)
    assert got[3]["license"] == "MIT" and got[3]["unit"] == "paragraph" and got[3]["score"] > 0.95
    assert got[5]["licenses"] == ["CC-BY-NC-4.0", "GPL-3.0"] and got[5]["n_units"] == 2
    assert all(got[i]["license"] is None and got[i]["n_units"] == 0 for i in (1, 2, 4, 6))


def test_licence_units_equal_plain_search():
    """Every line, paragraph and text against every template, without pruning."""
    matcher = license_scan.Matcher(license_scan.TEMPLATES, 0.6)
    texts = ["Licensed under the Apache License, Version 2.1\nof the words", "under the MIT License", "Released\nunder the MIT License.\n\nof the License"]
    column, feeds = license_scan._normal(pa.array(texts))
    found = license_scan.matched_units(license_scan.Words(column), feeds, matcher)
    for d, text in enumerate(texts):
        spans = {text, *text.split("\n"), *re.split(r"\n\s*\n", text)}
        best = 0.0
        for s in spans:
            w = re.findall(r"[a-z0-9]+", s.lower())
            grams = set(zip(w, w[1:], strict=False))
            for ts in license_scan.TEMPLATES.values():
                for t in ts:
                    v = re.findall(r"[a-z0-9]+", t.lower())
                    other = set(zip(v, v[1:], strict=False))
                    best = max(best, 2 * len(grams & other) / (len(grams) + len(other)) if grams else 0)
        assert max((f[0] for f in found.get(d, [])), default=0.0) == pytest.approx(best if best >= 0.6 else 0.0)


def test_licences_within_longer_texts(spark):
    """A notice of three paragraphs in a long document, one within a line, full texts; two in one line are two."""
    rnd = random.Random(4)
    mit = license_scan.TEMPLATES["MIT"][2]
    for cut in ("The above copyright", "THE SOFTWARE IS"):
        mit = mit.replace(cut, "\n\n" + cut)
    full = license_scan.TEMPLATES["GPL-3.0"][-1]
    rows = [
        (0, f"{prose(rnd, 200)}\n\n{mit}\n\n{prose(rnd, 200)}"),
        (1, "Copyright 2020 Foo Bar. Released under the MIT License."),
        (2, f"{prose(rnd, 50)} Licensed under CC0 1.0. {prose(rnd, 50)} Released under the ISC License. {prose(rnd, 50)}"),
        (3, f"{prose(rnd, 300)}\n{full}\n{prose(rnd, 300)}"),
        (4, f"{prose(rnd, 30)} under the license of the software {prose(rnd, 30)}"),
    ]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[0]["license"], got[0]["unit"], got[0]["score"], got[0]["n_units"]) == ("MIT", "window", 1.0, 1)
    assert (got[1]["license"], got[1]["unit"], got[1]["score"], got[1]["n_units"]) == ("MIT", "window", 1.0, 1)
    assert got[2]["licenses"] == ["CC0-1.0", "ISC"] and got[2]["n_units"] == 2
    assert got[3]["license"] == "GPL-3.0" and got[3]["score"] == 1.0
    assert got[4]["license"] is None and got[4]["n_units"] == 0


def test_licence_windows_equal_plain_search():
    """The best of all runs of words against every template, without pruning."""
    rnd = random.Random(8)
    some = {"X": ["a b c d e"], "Y": ["c d a b", "b a b a c"], "Z": ["d"]}
    texts = ["".join(rnd.choice(["a ", "b ", "c ", "d ", "e ", "\n"]) for _ in range(rnd.randint(0, 25))) for _ in range(150)]
    for templates in (some, {"X": some["X"], "Y": some["Y"]}):
        matcher = license_scan.Matcher(templates, 0.7)
        words = license_scan.Words(license_scan._normal(pa.array(texts))[0])
        found = license_scan.matched_windows(words, matcher, {})
        grams = lambda w: set(zip(w, w[1:], strict=False)) or set(w)
        for d, text in enumerate(texts):
            w = text.split()
            best = max((2 * len(a & b) / (len(a) + len(b)) for x in range(len(w)) for y in range(x + 1, len(w) + 1) for a in [grams(w[x:y])] for ts in templates.values() for t in ts for b in [grams(t.split())]), default=0.0)
            assert max((f[0] for f in found.get(d, [])), default=0.0) == pytest.approx(best if best >= 0.7 else 0.0)


def test_chat_reads_back(spark):
    rnd = random.Random(9)
    texts = ["</s>[INST] ok [/INST]", "\\", "\\[INST]", "", None, "a [TEXT] b", " x ", "\\\\</s>", "ü" * 50, "[ROLE] [SYS]", "<s>"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool", None, "[/ROLE]"]), rnd.choice(texts) if rnd.random() < 0.6 else prose(rnd, 30)) for c in range(12) for t in range(rnd.randint(1, 25))]
    rows += [(None, 1, "user", "hi"), (None, None, "assistant", "ho"), (3, 0, "user", "tie"), (3, 0, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(df, vocabulary_path(), budget=80, history=25)
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t, r or "", x or ""))
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    assert len(got) == len(by)
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in windows.collect():
        assert w["tokens"] <= 80 or w["n_new"] == 1
        assert len(chat.parse(w["text"])) == w["n_repeated"] + w["n_new"]
        if w["first_turn"] and by[w["conv_id"]][0][2] == "system":
            assert chat.parse(w["text"])[0][0] == "system"


def test_ann_hashes_small_tables(spark, monkeypatch):
    """Tables are fitted and probed for 500 rows as for more, with the recall asked for."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20, 8))[rng.integers(0, 20, 500)] + 0.2 * rng.normal(size=(500, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    fitted, fit = [], ann.fit
    monkeypatch.setattr(ann, "fit", lambda *a: fitted.append(fit(*a)) or fitted[-1])
    found = {(r["query_id"], r["vec_id"]) for r in ann.search(df, "vec_id % 5 = 0", k=5).collect()}
    assert fitted[0].a.shape[0] == ann.TABLES > 1
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    true = {(q, int(v)) for q in range(0, 500, 5) for v in np.argsort(-scores[q])[:5]}
    assert len(found) == 500 and len(found & true) >= 0.9 * len(true)


def test_host_rules_equal_brute_force(docs):
    got = host_rules.apply_rules(docs).collect()
    want = []
    for r in docs.collect():
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        want.append((r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)))
    assert sorted(tuple(r)[:7] for r in got) == sorted(want)
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_bad_hosts_take_their_documents_along(spark):
    good, bad = "one two three four five six seven eight nine ten", "no"
    rows = [(i, good if i % 10 else bad, "fine") for i in range(100)] + [(100 + i, bad if i % 10 else good, "poor") for i in range(100)] + [(200, good, None), (201, good, "new")]
    got = {r["doc_id"]: r for r in host_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1]["kept"] and not got[0]["kept"] and not got[100]["kept"] and got[200]["kept"] and got[201]["kept"]
    assert 0 < got[1]["host_rate"] < 0.2 < 0.8 < got[100]["host_rate"] < 1
    assert host_rules.apply_rules(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_host_prior_counts_hosts_of_one_document(spark):
    rows = [(f"h{i}", i % 4 > 0) for i in range(40)]
    of = lambda rows: {r["host"]: r["rate"] for r in host_rules.host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
    assert of(rows)["h0"] == pytest.approx(0.75 * 2 / 3) and of(rows)["h1"] == pytest.approx((1 + 0.75 * 2) / 3)
    # one larger host does not set the rate of the rest: 30 of 42 fail
    assert of(rows + [("big", False)] * 2)["h0"] == pytest.approx(30 / 42 * 2 / 3)


def labelled(spark, n=600):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        toxic, good = rnd.random() < 0.3, rnd.random() < 0.7
        sentences = [prose(rnd, 8, 80) + "." for _ in range(rnd.randint(2, 6))]
        if toxic:
            sentences[rnd.randrange(len(sentences))] = f"you {rnd.choice(['foul', 'vile'])} thing w3 w9!"
        text = " ".join(sentences)
        rows.append((i, text if good else " ".join(w + "###" for w in text.split())))
        labels.append((i, int(good), int(toxic)))
    rows += [(n, None), (n + 1, ""), (n + 2, " . \n")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def _accuracy(found, labels, column):
    want = {r["doc_id"]: r[column] for r in labels.collect()}
    rows = [r for r in found.collect() if r["doc_id"] in want and r["held_out"]]
    assert rows and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    return np.mean([r["predicted"] == want[r["doc_id"]] for r in rows])


def test_toxicity_of_held_out_documents(spark):
    docs, labels = labelled(spark)
    found = toxicity.classify(docs, labels)
    assert found.count() == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found.collect())
    assert _accuracy(found, labels, "toxic") > 0.93
    model = toxicity.fit(docs, labels)
    text = "w1 w2 w3. Gut, you foul thing w3 w9! w4 w5."
    row = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, locate=0.3).first()
    assert [text.encode()[s["start"] : s["start"] + s["length"]].decode() for s in row["offending"]] == ["Gut, you foul thing w3 w9"]


def test_noisy_or():
    assert toxicity.noisy_or(np.array([0.5, 0.5, 0.2]), np.array([0, 0, 2]), 3).tolist() == pytest.approx([0.75, 0, 0.2])


def test_quality_of_held_out_documents(spark):
    docs, labels = labelled(spark)
    assert _accuracy(quality_fm.classify(docs, labels), labels, "quality") > 0.95
    one = labels.limit(0)
    assert quality_fm.classify(docs, one).count() == docs.count() and toxicity.classify(docs, one).count() == docs.count()


def test_factorisation_machine_equals_sum_over_pairs():
    rng = np.random.default_rng(1)
    machine = quality_fm.Machine(0.1, rng.normal(size=50), rng.normal(size=(50, 4)))
    ids, x, at = np.array([3, 7, 9, 3, 40]), np.array([1.0, 0.5, 2.0, 1.0, 1.0]), np.array([0, 3, 5])
    raw, _ = machine.raw(ids, x, at)
    for d in range(2):
        i, v = ids[at[d] : at[d + 1]], x[at[d] : at[d + 1]]
        pairs = sum(machine.v[i[a]] @ machine.v[i[b]] * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert raw[d] == pytest.approx(0.1 + (machine.w[i] * v).sum() + pairs)


def test_ann_recall_ties_and_odd_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:140] = x[100]  # ties
    x[200:210] *= 3
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    odd = [(5001, None), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [1.0] * 15), (5005, [None] + [1.0] * 15), (5020, [float("inf")] * 16), (None, [1.0] * 16), (100, rows[100][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.search(df, "vec_id % 20 = 0", 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    assert set(got) == set(range(0, 3000, 20))
    full, hits = np.array([r[1] for r in rows]), []
    for q, found in got.items():
        s = full @ full[q]
        s[q] = -np.inf
        best = set(np.lexsort((np.arange(3000), -np.round(s, 12)))[:20].tolist())
        hits.append(len(best & {v for v, _, _ in found}) / 20)
        assert len(found) == 20 and [f[2] for f in found] == list(range(1, 21)) and all(abs(s[v] - p) < 1e-9 for v, p, _ in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert np.mean(hits) >= 0.9
    few = ann.search(df.where("vec_id < 5"), "vec_id = 0", 20)
    assert [r["vec_id"] for r in few.orderBy("rank").collect()] == sorted(range(1, 5), key=lambda i: -(full[0] @ full[i]))
    assert ann.search(df.limit(0), "vec_id = 0", 20).count() == 0


def test_pipeline_stages_work_on_what_is_left(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark, 300)
    extra = [(1000 + i, prose(random.Random(77), 80, 90) + (" edit" if i else "")) for i in range(3)]
    both = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string")).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    both.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == both.columns, name
        df.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        counts.append(df.count())
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    kept = {r["doc_id"] for r in df.collect()}
    assert counts == sorted(counts, reverse=True) and counts[0] < 306 and len(kept & toxic) < 0.1 * len(toxic)
    assert len(kept & {1000, 1001, 1002}) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).select("doc_id").distinct().count() == counts[-1]


def test_toxicity_learns_offensive_words_and_not_documents():
    """Unseen documents with an offensive sentence among rare words are found, others are left alone."""
    rng = np.random.default_rng(5)
    bad = "idiot stupid scum trash moron clown pathetic loser worthless disgusting".split()
    plain = [f"w{i}" for i in range(60_000)]
    texts, labels = [], np.arange(600) % 8 == 0
    for toxic in labels:
        said = [" ".join(plain[i] for i in rng.integers(0, len(plain), 12)) for _ in range(20)]
        if toxic:
            said.insert(int(rng.integers(21)), f"you {' '.join(rng.choice(bad, 2, replace=False))} {plain[rng.integers(len(plain))]}")
        texts.append(". ".join(said))
    ids, first, doc, words = toxicity.sentences(pa.array(texts))
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    bags = [(ids[words.first[i] : words.first[i + 1]], first[cut[i] : cut[i + 1]] - words.first[i]) for i in range(len(texts))]
    model = toxicity.train(bags[:400], labels[:400].astype(np.int64))
    score = toxicity.noisy_or(model.sentence_scores(ids, first), doc, len(texts))[400:]
    assert (score[labels[400:]] >= 0.5).mean() >= 0.95
    assert (score[~labels[400:]] >= 0.5).mean() <= 0.02


def test_signatures_with_the_same_members_are_kept_once(spark):
    """Members listed twice in two parts of the table do not make lists equal that differ."""
    lists = {1: [7, 8, 9], 2: [7, 8, 9], 3: [7, 8], 4: [8, 7], 5: [7, 7, 9], 6: [8, 8, 9], 7: [9, 8, 7]}
    work = Workspace(spark, "test")
    live = work.keep(spark.createDataFrame([(s, n) for s, nodes in lists.items() for n in nodes], "sig long, node long"), "live")
    found = defaultdict(list)
    for r in ngram_join._once(live, work).collect():
        found[r["sig"]].append(r["node"])
    assert {s: sorted(n) for s, n in found.items()} == {1: [7, 8, 9], 3: [7, 8], 5: [7, 7, 9], 6: [8, 8, 9]}


def test_the_last_round_meets_no_pairs_of_half_alike_sets(spark, monkeypatch):
    """Sets that hold too few shingles of other components meet none, whatever signatures they share (61 pairs did before)."""
    common, n = [f"c{i}" for i in range(150)], 60
    rows = [(i, " ".join(common + [f"d{i}x{j}" for j in range(50)])) for i in range(n)]
    rows += [(n + i, text + " more") for i, (_, text) in enumerate(rows[:5])]
    met, keep = {}, Workspace.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        if name.startswith("pairs-"):
            met[name] = out.count()
        return out

    monkeypatch.setattr(Workspace, "keep", counted)
    monkeypatch.setattr(ngram_join, "_possible", lambda *_: "true")
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 1)
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i % n for i in range(n + 5)}
    assert met["pairs-1"] == 0
