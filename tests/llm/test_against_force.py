"""Operators against plain Python on small texts and on the smallest tables."""

import collections
import hashlib
import random
import re
import struct

import brute
import pytest
import tiktoken
from public_tokenizers import PATTERN, path

import corpus_pipeline
from setwise.llm import bpe, decontaminate, minhash, pii, quality, queries, substrings, texts, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def edited(rng, words, share):
    return [rng.choice(("uno", "dos", "tres")) + str(rng.randrange(99)) if rng.random() < share else w for w in words]


def copies(seed, groups=6, size=25):
    """A template and its edited copies, chains of edits, and unrelated texts."""
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 200))]
        rows.append(base)
        for _ in range(size):
            rows.append(edited(rng, rng.choice((base, rows[-1])), rng.choice((0, 0.01, 0.02, 0.05, 0.3))))
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, documents, k, percent):
    for rows in (copies(k), documents):
        want = brute.components([i for i, _ in rows], brute.similar_pairs(rows, k, percent))
        found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), k=k, percent=percent).collect()
        assert {r.doc_id: r.component for r in found} == want
        assert all(r.kept == (r.doc_id == r.component) for r in found)


def test_estimate_follows_similarity(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base))] + [(i, " ".join(edited(rng, base, i / 100))) for i in range(1, 12)]
    sets = {i: set(zip(*[t.split()[j:] for j in range(3)], strict=False)) for i, t in rows}
    describe = minhash._describe(3)
    bits = describe([t for _, t in rows])[3]
    made = spark.createDataFrame([(i, b) for (i, _), b in zip(rows, bits, strict=True)], "key bigint, bits array<bigint>")
    from pyspark.sql import functions as F

    a = made.where("key = 0").select(F.struct("bits").alias("a"))
    got = made.select("key", F.struct("bits").alias("b")).crossJoin(a).select("key", minhash.similarity("a", "b").alias("s")).collect()
    for r in got:
        true = len(sets[0] & sets[r.key]) / len(sets[0] | sets[r.key])
        assert abs(true - r.s) < 0.18


def spans_by_force(rows, span=50):
    first = {}
    for i, t in sorted(rows):
        w = words_of(t)
        for p in range(len(w) - span + 1):
            first.setdefault(tuple(w[p : p + span]), i)
    out = {}
    for i, t in rows:
        w, gone = words_of(t), set()
        for p in range(len(w) - span + 1):
            if first[tuple(w[p : p + span])] < i:
                gone.update(range(p, p + span))
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


def passages(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"v{rng.randrange(10_000)}" for _ in range(n)]
    shared = [fresh(n) for n in (49, 50, 51, 60, 120, 300)] + [["for"] * 130, ["a", "b"] * 60]
    rows = []
    for i in range(160):
        w = fresh(rng.randrange(0, 80))
        for _ in range(rng.randrange(0, 3)):
            w += rng.choice(shared) + fresh(rng.randrange(0, 40))
        if rng.random() < 0.3 and rows:
            w = edited(rng, rng.choice(rows)[1].split(), rng.choice((0, 0.01)))
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("group", [4000, 3])
def test_substrings(spark, documents, group):
    """With tiny groups every shared prefix is lengthened to the window."""
    for rows in (passages(1), passages(2), documents):
        found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), group=group).collect()
        want = spans_by_force(rows)
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in found} == want


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(
            (2 * int(d) - 9 * (d > "4")) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_by_force(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if holds(k, m[0]))


def test_personal_data(spark, documents):
    rng = random.Random(3)
    noise = [("".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for alphabet in ("0123456789.- +()a@", "ab@.-1%+é ", "12.. ", "+1 (.)-9") for _ in range(4000)]
    anchors = pii._anchors()
    for text in noise:
        assert pii.listed(pii.find_spans(text, anchors), pii.BASE) == base_by_force(text), text
    found = {r.doc_id: r for r in queries.QUERIES["op2_personal_data"](spark, FOLDER).collect()}
    for i, text in documents:
        assert found[i].base_sha256 == hashlib.sha256(base_by_force(text).encode()).hexdigest()
        assert set(filter(None, base_by_force(text).split(","))) <= set(found[i].spans.split(","))


def test_added_spans_and_redaction():
    text = 'See https://example.org/a?b=1. token = "ab12cd34ef", mail a.b@c.de or +49 (30) 1234567; my token is old'
    found = pii.find_spans(text, pii._anchors())
    assert [text[a:b] for a, b in found["url"]] == ["https://example.org/a?b=1"]
    assert [text[a:b] for a, b in found["account"]] == ["ab12cd34ef"]
    assert pii.redact(text, found) == 'See [URL]. token = "[ACCOUNT]", mail [EMAIL] or [PHONE]; my token is old'


def test_byte_bpe(spark, documents):
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    rng = random.Random(4)
    alphabet = "absTtrevlmd'' ''  \n\t\r\x0b\x1c\x85\xa0 　é²½日!?.#12٣́😀​"
    noise = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(5000)]
    noise += ["", None, "a" * 3000, " " * 3000, "\n" * 2000 + "x", "!" * 2000, "'s" * 500]
    got = bpe.encode_texts(noise, bpe.Pieces(bpe.read_ranks(path("byte_bpe_multi_50k.tiktoken"))))
    for text, ids in zip(noise, got, strict=True):
        want = encoding.encode_ordinary(text or "")
        assert ids == struct.pack(f"<{len(want)}I", *want), text
    found = {r.doc_id: r for r in queries.QUERIES["op10_byte_bpe"](spark, FOLDER).collect()}
    for i, text in documents:
        want = encoding.encode_ordinary(text or "")
        assert found[i].n_tokens == len(want)
        assert found[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_starts_point_into_the_text(spark):
    text = "Naïve café — 12 coins, it's fine"
    r = bpe.encode(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), corpus_pipeline.RANKS).first()
    starts = struct.unpack(f"<{r.n_tokens}I", r.starts)
    tokens = {i: t for t, i in bpe.read_ranks(corpus_pipeline.RANKS).items()}
    for at, i in zip(starts, struct.unpack(f"<{r.n_tokens}I", r.ids), strict=True):
        assert text.encode()[at:].startswith(tokens[i])


def test_search_in_blocks(spark):
    """Many blocks of windows give what one block gives."""
    rng = random.Random(6)
    word = lambda: rng.choice("abcde")
    items = [(f"i{n}", " ".join(word() for _ in range(rng.choice((1, 3, 12, 13, 14, 30))))) for n in range(30)]
    docs = [(n, " ".join(word() for _ in range(60)) + ". " + rng.choice(items)[1].upper()) for n in range(40)]
    docs, items = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string")
    one, many = (sorted(decontaminate.find_contamination(docs, items, block_bytes=b).collect()) for b in (1 << 20, 300))
    assert one == many
    for r in one[:10]:
        words = next(t for i, t in ((d.doc_id, d.text) for d in docs.collect()) if i == r.doc_id).lower().replace(".", "").split()
        hit, who = set(), set()
        for i in items.collect():
            w = i.text.split()
            for at in range(max(len(w) - 13, 0) + 1):
                g = w[at : at + 13]
                for p in range(len(words) - len(g) + 1):
                    if words[p : p + len(g)] == g:
                        hit.update(range(p, p + len(g)))
                        who.add(i.item_id)
        assert (r.n_hit, r["items"]) == (len(hit), sorted(who))


def test_suffix_array_repeats():
    rng = random.Random(7)
    for _ in range(60):
        lines = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40))) for _ in range(5)]
        got = quality.measure(lines)
        for i, text in enumerate(lines):
            w = text.split()
            longest = max((n for n in range(8, len(w)) if len({tuple(w[p : p + n]) for p in range(len(w) - n + 1)}) < len(w) - n + 1), default=0)
            seen = collections.Counter(tuple(w[p : p + 8]) for p in range(len(w) - 7))
            inside = {q for p in range(len(w) - 7) if seen[tuple(w[p : p + 8])] > 1 for q in range(p, p + 8)}
            assert (got[4][i], got[6][i]) == (len(inside), longest)


def test_folding_and_exceptions():
    assert toxicity.fold("Ídi0t m0ron сlоwn 2024 cl0wn") == "idiot moron clown 2024 clown"
    lexicon = toxicity.Lexicon({("clown", True): 3.0, ("mor", False): 2.0}, frozenset({("clown", "fish")}), (0.0, 1.0, 1.0))
    a = lexicon.automaton()
    assert [h[2] for h in toxicity.hits(toxicity.fold("A clown, a clown fish, clowning m0rons"), a, lexicon.exceptions)] == [3.0, 2.0]


def test_held_out_language(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op4_language"](spark, "/root/testdata/sf0.01").collect()}
    true = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert len(held) > 200
    assert sum(got[i].lang_pred == true[i] for i in held) >= 0.99 * len(held)


def test_mixed_text_gets_spans(spark):
    from setwise.llm import language

    rows = [(1, "the cat and the dog with this thing and that one " * 20, "en"), (2, "der hund und die katze mit einem ding und jenem " * 20, "de"),
            (3, "это кошка и собака с этой вещью " * 20, "ru")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(docs)
    text = "the dog and that thing with the cat 12 der hund und die katze mit einem ding и кошка с вещью"
    (r,) = language.identify(spark.createDataFrame([(9, text)], "doc_id bigint, text string"), model, switch=3.0).collect()
    assert [(s.lang, text[s.start : s.end]) for s in r.lang_spans] == [
        ("en", "the dog and that thing with the cat"), ("de", "der hund und die katze mit einem ding"), ("ru", "и кошка с вещью")]


def test_held_out_toxicity(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    true = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [i for i in true if got[i].held_out]
    caught = sum(got[i].predicted for i in held if true[i])
    assert caught >= 0.85 * sum(true[i] for i in held)
    assert sum(got[i].predicted for i in held if not true[i]) <= 0.01 * len(held)


def test_word_splitting():
    assert texts.space_words("A b\x0bC\x1cd é", lower=True) == ["a b".encode(), b"c\x1cd", "é".encode()]
    assert texts.plain_words("Don't STOP: É2-x") == [b"don", b"t", b"stop", "É2".encode(), b"x"]
