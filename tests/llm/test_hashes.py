"""Hashes of words, lines and windows on strings that collide under polynomial hashes, and on very long texts."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from cellmend.llm import bpe, host_rules, license_scan, ngram_join, substring
from cellmend.llm.queries import vocabulary_path
from cellmend.llm.textvec import Words, hashed, numbered


def thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


ONE, TWO = thue_morse(2048)


def test_words_lines_and_windows_are_told_apart():
    w = Words(pa.array([ONE, TWO, " ".join(ONE), " ".join(TWO)]))
    assert len(set(w.hashes.tolist())) == 4
    for k in (64, 1024, 2048):
        h, counts = w.windows(k)
        texts = [" ".join(x[i : i + k]) for x in (ONE, TWO) for i in range(2048 - k + 1)]
        assert len(set(h.tolist())) == len(set(texts)) and len(set(zip(h.tolist(), texts))) == len(set(texts))
    stats = host_rules.text_stats(pa.array([f"{ONE}\n{TWO}\n{ONE}"]))
    assert stats["n_dup_lines"].tolist() == [1]


def test_hashes_follow_the_bytes():
    rnd = random.Random(1)
    texts = [bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 1, 7, 8, 9, 16, 17, 63, 700]))) for _ in range(300)] + [b"", b"\0", b"\0\0", b"a\0"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    h, n = hashed(data, starts, ends), numbered(data, starts, ends)
    assert len(set(h.tolist())) == len(set(texts)) == len(set(zip(h.tolist(), texts))) == len(set(zip(n.tolist(), texts))) == len(set(n.tolist()))
    other = np.frombuffer(b"x" + b"".join(texts), np.uint8)  # another place, the same hash
    assert (hashed(other, starts + 1, ends + 1) == h).all() and (hashed(data, starts, ends, 5) != h).all()


@pytest.fixture(scope="module")
def twins(spark):
    """Two long words, two long texts of words, each pair equal under a polynomial modulo 2**64."""
    return spark.createDataFrame([(0, ONE), (1, TWO), (2, " ".join(ONE)), (3, " ".join(TWO))], "doc_id long, text string")


def test_operators_tell_them_apart(spark, twins):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    text = {r["doc_id"]: r["text"] for r in twins.collect()}
    assert {r["doc_id"]: r["ids"] for r in bpe.encode(twins.coalesce(1), vocabulary_path()).collect()} == {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in text.items()}
    links = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_join(twins, 2048, 85).collect()}
    assert links == {0: 0, 1: 1, 2: 2, 3: 3}
    assert {r["doc_id"]: r["n_removed"] for r in substring.digests(twins, 1024).collect()}.get(0) == 0
    whole = spark.createDataFrame([(0, " ".join(ONE)), (1, " ".join(TWO))], "doc_id long, text string")
    assert [r["n_removed"] for r in substring.digests(whole, 2048).collect()] == [0, 0]
    found = {r["doc_id"]: r["license"] for r in license_scan.scan(twins, templates={"X": [f"{ONE} end"]}).collect()}
    assert set(found.values()) == {None}
    found = {r["doc_id"]: r["license"] for r in license_scan.scan(twins, templates={"X": [ONE]}).collect()}
    assert found == {0: "X", 1: None, 2: None, 3: None}


def test_very_long_texts(spark):
    """One text of several chunks among short ones: the same results as the library's and plain Python's."""
    from tokenizers import Tokenizer

    rnd = random.Random(3)
    long = " ".join(f"{rnd.choice(['w', 'Über', 'x1', '...', 'it’s', 'don' + chr(39) + 't'])}{rnd.randrange(5000)}" for _ in range(700_000))
    solid = "ab12" * 700_000  # one word of more than a chunk
    df = spark.createDataFrame([(0, "short one"), (1, long), (2, None), (3, solid), (4, long + " more")], "doc_id long, text string")
    tokenizer = Tokenizer.from_file(vocabulary_path())
    got = {r["doc_id"]: r for r in bpe.digests(df, vocabulary_path()).collect()}
    for d, t in ((0, "short one"), (1, long), (2, "")):
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert got[3]["decoded_sha256"] == hashlib.sha256(solid.encode()).hexdigest()
    links = {r["doc_id"]: (r["n_shingles"] > 0, r["component_id"]) for r in ngram_join.jaccard_join(df, 4, 85).collect()}
    assert links == {0: (True, 0), 1: (True, 1), 2: (False, 2), 3: (True, 3), 4: (True, 1)}
    gone = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.digests(df).collect()}
    assert gone[1] == (700_000, 700_000) and gone[4] == (700_001, 700_000) and gone[3] == (1, 0)
