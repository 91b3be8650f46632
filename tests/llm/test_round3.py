"""Tree BPE, cross-tokenizer alignment and source divergence against libraries and brute force, and on awkward tables."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperloom.llm import alignment, divergence, registry, tree_bpe

SF = "/root/testdata/sf0.001"
MULTI, BYTE_BPE, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
EDGE = [
    (1, None, "en", "a", 0), (2, "", None, None, 0), (None, "some text without an id", "en", "a", 5), (4, "twice twice", "fr", "b", None), (4, "twice twice", "fr", "b", None),
    (5, LONG, "en", "a", len(LONG)), (6, " \n\t ", "de", "b", 4), (7, "é" * 5000, "fr", "b", 5000), (8, "a▁b", None, "b", 8), (4, "same id, <|endoftext|> <s>", "en", "c", 1),
]
ALPHABETS = ["ab", "a ", "aA1 .,", "  \n\tx", "日本語のは。 ", "éüß s'tll", "абвг ", "=-_*", "0123", "<s> </s>|endoftext", "\x00\x1f ﬁé１", "😀👩‍💻 ", "▁ a"]


def random_texts(seed, n, longest=400):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(longest))) for letters in (rng.choice(ALPHABETS) for _ in range(n))]


def numbers(raw):
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


@pytest.fixture(scope="module")
def edge(spark):
    names = ["pairs", "times", "row", "pair", "term", "block", "slice", "n", "df", "n_tokens", "a.b"]
    return spark.createDataFrame(EDGE, DOCS).withColumns({f"`{n}`" if "." in n else n: F.lit(-7) for n in names})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---------------------------------------------------------------- 11 tree BPE

@pytest.fixture(scope="module")
def multi():
    ours = tree_bpe.TreeBpe(MULTI)
    return ours, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})


def test_tree_equals_the_library(multi):
    ours, library = multi
    rng = random.Random(11)
    texts = random_texts(11, 400) + [rng.choice("aé =") * rng.randrange(1, 3000) + t for t in random_texts(12, 60)] + [LONG]
    for text in texts:
        ids = ours.encode(text)
        assert numbers(ids) == library.encode_ordinary(text), text
        assert ours.decode(ids) == text.encode()


def test_pieces_part_as_the_library_does_at_every_character(multi):
    ours, library = multi
    for first in range(0, 0x30000, 64):
        text = "".join(f"a{chr(c)}b 1{chr(c)} {chr(c)}{chr(c)}.x" for c in range(first, first + 64) if not 0xD800 <= c < 0xE000)
        assert numbers(ours.encode(text)) == library.encode_ordinary(text), hex(first)


def test_tree_equals_plain_merges_for_any_ranks():
    """Whatever the ranks, also such that no training gives, halves joined at growing windows are what the plain merges give."""
    rng = random.Random(3)
    for _ in range(1500):
        letters = [b"a", b"b", b"c"]
        tokens = sorted({*letters, *(b"".join(rng.choices(letters, k=rng.randrange(2, 6))) for _ in range(rng.randrange(2, 25)))})
        rng.shuffle(tokens)
        ours = tree_bpe.TreeBpe.__new__(tree_bpe.TreeBpe)
        ours.set_ranks({t: i for i, t in enumerate(tokens)})
        raw = b"".join(rng.choices(letters, k=rng.randrange(1, 150)))
        assert ours.tree(raw) == ours.merge(raw) == ours.merge_by_heap(raw)


def test_joining_is_associative(multi):
    ours, _ = multi
    rng = random.Random(4)
    for _ in range(300):
        x, y, z = (ours.merge("".join(rng.choices("abth eing", k=rng.randrange(12))).encode()) for _ in range(3))
        assert ours.join(ours.join(x, y), z) == ours.join(x, ours.join(y, z))
        assert ours.join([], x) == x == ours.join(x, [])


def test_tree_query(spark, documents, multi):
    got = {r.doc_id: r for r in registry.op11_tree_bpe(spark, SF).collect()}
    rows = documents.collect()
    assert len(rows) == len(got)
    for r in rows:
        ids = multi[1].encode_ordinary(r.text or "")
        want = len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == want


def test_tree_edges(edge, none, multi):
    rows = tree_bpe.tree_decode(tree_bpe.tree_encode(edge, MULTI), MULTI).collect()
    want = Counter((i, t or "") for i, t, *_ in EDGE)
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in rows) == want
    assert all(numbers(r.ids) == multi[1].encode_ordinary(bytes(r.decoded).decode()) for r in rows)
    assert tree_bpe.tree_digests(edge, MULTI).count() == len(EDGE)
    assert tree_bpe.tree_digests(none, MULTI).count() == tree_bpe.tree_encode(none, MULTI).count() == 0


# ---------------------------------------------------------------- 12 alignment

def test_piece_units_equal_the_library():
    ours, library = alignment.PieceEncoder(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in random_texts(21, 2000) + ["", " ", "  ", "a  b ", LONG]:
        if "▁" in text:
            with pytest.raises(alignment.NotTheText):
                ours.encode(text)
        else:
            assert numbers(ours.encode(text)) == library.encode(text), text


def brute_alignments(texts):
    """Each text's groups and links, token by token, with the libraries' ids."""
    a_model, b_model = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_model.encode_special_tokens = True
    from paperloom.llm.bpe import byte_alphabet

    letters = byte_alphabet()
    out = []
    for text in texts:
        raw = b" " + (text or "").encode()
        a = [(i, bytes(letters[c] for c in a_model.id_to_token(i))) for i in a_model.encode(raw.decode(), add_special_tokens=False).ids]
        pieces = [(i, b_model.id_to_piece(i)) for i in b_model.encode(text or "")]
        b = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()) for i, p in pieces]
        if not text or any(b"".join(t for _, t in side) != raw for side in (a, b)):
            out.append(([], [], [], []))
            continue
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, token in side:
                own.append((at, at + len(token), i))
                at += len(token)
            spans.append(own)
        groups, low = [], 0
        for cut in sorted({q for _, q, _ in spans[0]} & {q for _, q, _ in spans[1]}):
            groups.append("|".join(",".join(str(i) for _, q, i in side if low < q <= cut) for side in spans))
            low = cut
        links = [(i, j) for p, q, i in spans[0] for u, v, j in spans[1] if p < v and u < q]
        out.append(([i for i, _ in a], [i for i, _ in b], groups, links))
    return out


def brute_rows(docs):
    found = brute_alignments([t for _, t in docs])
    count = Counter(link for *_, links in found for link in links)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    rows = []
    for (doc_id, _), (a, b, groups, links) in zip(docs, found, strict=True):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        rows.append((doc_id, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest))
    return Counter(rows)


def test_alignment_equals_brute_force():
    tables, rng = alignment.load(BYTE_BPE, PIECES), random.Random(5)
    for _ in range(60):
        texts = [rng.choice(random_texts(rng.random(), 3, 60)) for _ in range(rng.randrange(9))]
        found = alignment.Aligned(tables, [tables.tokens(t) for t in texts])
        want = brute_alignments(texts)
        assert found.n_groups().tolist() == [len(w[2]) for w in want]
        assert found.group_texts() == [";".join(w[2]).encode() for w in want]
        got = [Counter() for _ in texts]
        for document, pair, times in zip(*(x.tolist() for x in found.pairs()), strict=True):
            got[document][pair >> alignment.SHIFT, pair & (1 << alignment.SHIFT) - 1] += times
        assert got == [Counter(w[3]) for w in want]


@pytest.mark.parametrize("broadcast_pairs", [alignment.BROADCAST_PAIRS, 0])
def test_links_equal_brute_force(spark, documents, edge, broadcast_pairs, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_BYTES", 2000)
    some = [(r.doc_id, r.text) for r in documents.collect() if len(r.text or "") < 1500][:60]
    rows = some + [(i, t) for i, t, *_ in EDGE if len(t or "") < 1500]
    got = alignment.token_links(spark.createDataFrame(rows, "doc_id long, text string"), BYTE_BPE, PIECES, broadcast_pairs)
    assert Counter(map(tuple, got.collect())) == brute_rows(rows)


def test_alignment_edges(spark, edge, none):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = alignment.token_links(edge, BYTE_BPE, PIECES)
    assert got.columns == names and got.count() == len(EDGE)
    assert [tuple(r)[1:] for r in got.filter("doc_id in (1, 2, 8)").collect()] == [(0, 0, 0, 0, 0, 0, "")] * 3
    assert alignment.token_links(none, BYTE_BPE, PIECES).count() == 0
    rows = alignment.aligned(edge, BYTE_BPE, PIECES).filter("doc_id = 4").collect()
    assert len(rows) == 3 and all(r.groups.count(";") + 1 == r.n_groups and sum(r.times) == r.n_links for r in rows)
    assert registry.op12_alignment(spark, SF).columns == names


# ---------------------------------------------------------------- 13 divergence

def brute_divergence(docs, min_docs=10):
    n, df, groups = Counter(), Counter(), set()
    for text, lang, source in ((t or "", x or "", s or "") for t, x, s in docs):
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
        groups.add((lang, source))
        df.update((lang, t) for t in set(terms))
        n.update((lang, source, t) for t in terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for (x, t), c in df.items() if x == lang and c >= min_docs), key=str.encode)
        sources = sorted((s for x, s in groups if x == lang), key=str.encode)
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 2) // (sum(counts.values()) + 2 * len(kept)) for t in kept}
        counts = {s: {t: n[lang, s, t] for t in kept} for s in sources}
        p = {s: share(counts[s]) for s in sources}
        q = share({t: sum(counts[s][t] for s in sources) for t in kept})
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, 10)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[:most], 1)]
    return Counter(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergence_equals_brute_force(spark, small, monkeypatch):
    """Also with tiles of a few cells, several slices of sources, and ties."""
    if small:
        for name, value in (("CELLS", 64), ("LEAST_TERMS", 3), ("MOST_TERMS", 5), ("SLICE", 3)):
            monkeypatch.setattr(divergence, name, value)
    rng = random.Random(6)
    words = ["the", "The", "ÉTÉ", "été", "don't", "x", "日本", "a1b", "zz", "ﬀ", "😀", *(f"w{chr(97 + i)}" for i in range(26))]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["en", "fr", None]), rng.choice("abcdefghij")) for _ in range(300)]
    rows += [(None, "de", None), ("", "de", "q"), ("only here", "de", "r"), (None, None, None), ("x" * 3000, "en", "lonely")] + [rows[0]] * 3
    got = divergence.source_divergence(spark.createDataFrame(rows, "text string, lang string, source string"))
    assert Counter(map(tuple, got.collect())) == brute_divergence(rows)


def test_shares_are_exact():
    rng = random.Random(7)
    for _ in range(300):
        total = rng.randrange(1, 10 ** rng.randrange(2, 16)) + 2
        count = rng.randrange(0, total - 1)
        assert divergence.shares(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 2) // total


def test_counts_are_handed_over_in_parts(spark, documents, monkeypatch):
    whole = divergence.counted(documents.coalesce(1)).collect()
    terms = Counter()
    for r in documents.collect():
        terms.update((r.lang or "", r.source or "", t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r.text or "").translate({c: c + 32 for c in range(65, 91)})))
    assert {(r.lang, r.source, r.term): r.n for r in whole if r.term} == terms


def test_divergence_edges(spark, edge, none):
    got = divergence.source_divergence(edge)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == brute_divergence([(t, x, s) for _, t, x, s, _ in EDGE])
    assert divergence.source_divergence(none).count() == 0


def test_vocabulary_file_is_read_whole():
    with open(MULTI, "rb") as f:
        lines = [x.split() for x in f if x.strip()]
    assert tree_bpe.TreeBpe(MULTI).ranks == {base64.b64decode(t): int(i) for t, i in lines}
