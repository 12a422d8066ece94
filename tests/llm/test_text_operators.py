"""Edge cases and brute-force checks of the operators on texts."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluxcell.llm import fingerprints, language_id, line_dedup, pieces, quality, secret_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, langs=None, first=0):
    data = [(i + first, t, (langs or {}).get(i), None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, DOCS)


ODD = [None, "", " ", "\n\n", "x", "a\x00b", "🙂 é\t ", "word " * 3000, "word " * 3000, "y" * 5000]


# line dedup


def brute_lines(rows):
    keys, last = {}, {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
            if len(k) >= 20 and d is not None:
                keys.setdefault(k, set()).add(d)
    out = []
    for d, t in rows:
        kept, n = [], 0
        for line in (t or "").split("\n"):
            n += 1
            k = line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
            held = keys.get(k, ())
            if d is None or len(held) < 3 or d == max(held):
                kept.append(line)
        out.append((d, n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup_matches_brute_force(spark):
    line, other = "This line is long enough to count", "  ANOTHER line that is long enough\t"
    texts = [f"{line}\nrest {i}\n{other}\n{line}" for i in range(4)] + [other.lower() + "\nshort\nshort", *ODD, line.upper()]
    rows = list(enumerate(texts)) + [(None, line), (0, texts[0]), (0, line + "\nnew")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.line_dedup(df).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("h")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_lines(rows)


def test_line_dedup_keeps_clashing_columns(spark):
    df = docs(spark, ["a\nb"]).withColumns({"n_lines": F.lit("old"), "key": F.lit(1), "__x": F.lit(2), "pos": F.lit(3)})
    r = line_dedup.line_dedup(df).first()
    assert (r["n_lines"], r["key"], r["__x"], r["pos"], r["kept_text"]) == (2, 1, 2, 3, "a\nb")
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


# secrets


def test_secret_spans_match_regular_expressions(spark):
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    texts = [
        "é token = \"abcDEF123\" 🙂 AKIA" + "Z9" * 10,
        "token: token: abcdefgh password='x' PassWord : ' secret99",
        "0123456789abcdef" * 2 + " AKIAABC AKIA" + "A" * 16,
        "deadbeef" * 2 + " api_key=" + "f" * 30 + " apikey:abcdef",
        *ODD,
    ]
    got = {r["doc_id"]: r for r in secret_scan.secret_spans(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in a.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [(s["start"], s["kind"], s["end"]) for s in got[i]["base_spans"]] == sorted(want)
        assert set(got[i]["base_spans"]) <= set(got[i]["spans"])


def entropy(s, w):
    best = 0.0
    for i in range(len(s) - w + 1):
        n = np.array([s[i : i + w].count(c) for c in set(s[i : i + w])]) / w
        best = max(best, float(-(n * np.log2(n)).sum()))
    return best


def test_window_entropy_is_incremental_but_exact(spark):
    strings = ["aB3xQ9zLmN0pRtYuIoWe7v", "a" * 30, "ab" * 15, "Zk4" * 12 + "qwertyuiopasdfgh1234"]
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    got = [r[0] for r in df.select(secret_scan.window_bits(F.col("s"))).collect()]
    assert got == pytest.approx([entropy(s, 20) for s in strings])


def brute_spans(text):
    """Every span of a text as kind:start:end, with Python's own expressions and windows worked out afresh."""
    a = re.compile(secret_scan.ASSIGN.removeprefix("(?i)"), re.I | re.A)
    base = [(m.start(), 0, m.end()) for m in a.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    more = []
    for m in re.finditer(secret_scan.CANDIDATE, text):
        s = m[0]
        parts = re.split("[-_/]", s)
        allowed = (
            re.fullmatch("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", s)
            or len(parts) > 1 and all(re.fullmatch("[A-Za-z]+|[0-9]+", x) for x in parts)
            or re.search("example|sample|placeholder|dummy", s, re.I)
        )
        if not re.search("[0-9]", s) or not re.search("[A-Za-z]", s) or allowed:
            continue
        if any(b[0] <= m.start() and m.end() <= b[2] for b in base):
            continue
        if entropy(s, 20) >= (3.0 if re.fullmatch("[0-9a-fA-F]+", s) else 3.8):
            more.append((m.start(), 3, m.end()))
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + more))


def test_all_spans_match_brute_force_on_the_whole_table(spark):
    got = secret_scan.op8_secret_scan(spark, "/root/testdata/sf0.001").collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(text)
    assert all(r["spans"] == brute_spans(text[r["doc_id"]] or "") for r in got)


def test_entropy_spans_and_allow_list(spark):
    texts = ["key aB3xQ9zLmN0pRtYuIoWe7v end", "id 123e4567-e89b-12d3-a456-426614174000", "n 11111111111111111111a1", "see exampleB3xQ9zLmN0pRtYuIoW", "my-long-page-title/2023-11-05", "aB3xQ9zLmN0pRtYuIoWe7v=" + "z" * 40]
    got = [r["spans"] for r in secret_scan.secret_spans(docs(spark, texts)).orderBy("doc_id").collect()]
    assert [[s["kind"] for s in x] for x in got] == [[3], [], [], [], [], [3]]
    assert secret_scan.secret_spans(docs(spark, ["x"]).limit(0)).count() == 0


def test_long_texts_are_scanned_whole(spark):
    import base64

    rng = np.random.default_rng(4)
    texts = [
        "a-" * 100_000 + "1",
        base64.b64encode(rng.bytes(750_000)).decode(),
        " ".join(rng.bytes(16).hex() for _ in range(5000)),
        "x1" * 20_000 + "aB3xQ9zLmN0pRtYuIoWe7v",
        "password" + " " * 100_000,
    ]
    got = [r["spans"] for r in secret_scan.secret_spans(docs(spark, texts)).orderBy("doc_id").collect()]
    assert [len(x) for x in got] == [0, 1, 5000, 1, 0]
    assert got[1][0]["end"] == len(texts[1]) and got[3][0]["end"] == len(texts[3])
    assert [(s["start"], s["end"]) for s in got[2]] == [(33 * i, 33 * i + 32) for i in range(5000)]


# fingerprints


def test_fingerprints_edit_and_neighbour(spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(12)] + [None, "", "one 🙂 short"]
    texts.append(texts[3])
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_neighbours(docs(spark, texts, first=5)).collect()}
    full = [t or "" for t in texts]
    for i, t in enumerate(full):
        n = len(t) // 4
        edited = t[: len(t) - n] + full[(i + 1) % len(full)][:n]
        r = got[i + 5]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if len(t) > 800:
            assert 0.55 < r["near_edited"] <= 1 and r["near_next"] < 0.3
    assert got[8]["fingerprint"] == got[5 + 15]["fingerprint"] and got[17]["fingerprint"] == got[18]["fingerprint"] == ""


def test_chunks_survive_a_shift():
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 5000))
    a, b = fingerprints.digests(text), fingerprints.digests("inserted words " + text)
    assert fingerprints.likeness(a, b) > 0.95
    sizes = [e - s for s, e in fingerprints.chunks(np.frombuffer(text.encode("utf-32-le"), np.uint32))]
    assert sum(sizes) == 5000 and max(sizes) <= fingerprints.LONGEST and min(sizes[:-1]) >= fingerprints.SHORTEST


def test_fingerprints_odd_tables(spark):
    df = spark.createDataFrame([(None, "a" * 50), (7, "b" * 50), (7, "b" * 50), (7, None)], "doc_id long, text string")
    assert fingerprints.fingerprint_neighbours(df).count() == 4
    assert fingerprints.fingerprint_neighbours(df.where("doc_id = 9")).count() == 0
    assert fingerprints.fingerprint_neighbours(df.limit(1)).count() == 1


# language


def test_language_learns_and_handles_odd_texts(spark):
    rng = np.random.default_rng(2)
    vocab = {"aa": ["kor", "tul", "ven", "mai"], "bb": ["sch", "ung", "zer", "pfo"]}
    texts, langs = [], {}
    for i in range(80):
        lang = "aa" if i % 2 else "bb"
        texts.append(" ".join("".join(rng.choice(vocab[lang], 2)) for _ in range(20)))
        langs[i] = lang
    texts += ODD
    got = {r["doc_id"]: r for r in language_id.identify_language(spark, docs(spark, texts, langs)).collect()}
    assert len(got) == len(texts)
    held = [i for i in range(80) if got[i]["held_out"]]
    assert held and all(got[i]["lang_pred"] == langs[i] for i in held)
    import zlib

    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    for k in range(4):
        assert got[80 + k]["lang_pred"] == "und" and got[80 + k]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_without_labels_or_rows(spark):
    assert {r["lang_pred"] for r in language_id.identify_language(spark, docs(spark, ["abc", None])).collect()} == {"und"}
    assert language_id.identify_language(spark, docs(spark, ["abc"]).limit(0)).count() == 0


def test_forward_sums_all_segmentations():
    p = ["▁a", "▁", "a", "b", "ab", "▁ab", "▁aba"]
    prob = np.array([[0.1], [0.2], [0.05], [0.15], [0.2], [0.1], [0.2]])
    s = language_id.Scorer(p, prob)

    def brute(w):
        if not w:
            return 1.0
        return sum(prob[p.index(w[:k]), 0] * brute(w[k:]) for k in range(1, len(w) + 1) if w[:k] in p)

    # the start mark travels with the first piece of a word
    got = s.forward(["abab"], 4)[4][0, 0]
    want = brute("▁abab") - prob[1, 0] * brute("abab")
    assert got == pytest.approx(want)
    assert s.log_forward(s.steps("abab"))[4, 0] == pytest.approx(np.log(want))


def log_sums(word, p, longest, unknown):
    """log of the sum over all segmentations of prefixes, term by term, without arrays."""
    from math import exp, log

    a = [0.0]
    for end in range(1, len(word) + 1):
        terms = []
        for start in range(max(0, end - longest), end):
            piece = word[start:end] if start else "▁" + word[:end]
            got = p.get(piece, unknown if end - start == 1 else 0)
            if got:
                terms.append(a[start] + log(got))
        a.append(max(terms) + log(sum(exp(t - max(terms)) for t in terms)))
    return a


def test_runs_of_any_length_are_summed_whole():
    rng = np.random.default_rng(5)
    pieces = ["▁a", "▁", "a", "b", "ab", "ba", "▁ab", "aab", "bbb"]
    prob = rng.dirichlet(np.ones(9), 2).T
    s = language_id.Scorer(pieces, prob)
    for n in (31, 32, 33, 70, 5000):
        word = "".join(rng.choice(list("abc"), n, p=[0.5, 0.45, 0.05]))  # c is in no piece
        want = [log_sums(word, dict(zip(pieces, prob[:, k], strict=True)), s.longest, language_id.UNKNOWN)[-1] for k in range(2)]
        assert s.of([[word]])[0] == pytest.approx(want)
    assert language_id.words_of("x" * 100 + " y1Z") == ["x" * 100, "y", "z"]


def test_expected_counts_match_enumeration():
    pieces = ["▁a", "▁", "a", "b", "ab", "▁ab", "ba"]
    prob = np.array([[0.1], [0.2], [0.05], [0.15], [0.2], [0.1], [0.2]])
    s = language_id.Scorer(pieces, prob)
    p = dict(zip(pieces, prob[:, 0], strict=True))

    def ways(word, first):
        if not word:
            yield []
        for k in range(1, len(word) + 1):
            piece = ("▁" if first else "") + word[:k]
            if piece in p:
                yield from ([piece, *rest] for rest in ways(word[k:], False))

    want, total = dict.fromkeys(pieces, 0.0), 0.0
    for way in ways("abaab", True):
        w = np.prod([p[x] for x in way])
        total += w
        for x in way:
            want[x] += w
    for got in (language_id.expected_counts(s, ["abaab"], 0, np.array([3.0])), language_id.long_expected_counts(s, "abaab", 0, 3.0)):
        assert got[:7] == pytest.approx([3 * want[x] / total for x in pieces])


# quality


def test_quality_keeps_good_and_drops_bad(spark):
    rng = np.random.default_rng(3)
    w = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(200)]
    good = [". ".join(" ".join(rng.choice(w, 6)).capitalize() for _ in range(8)) for _ in range(160)]
    bad = [" ".join(f"{x}###" for x in rng.choice(w, 40)) for _ in range(40)]
    df = docs(spark, good + bad + [None, "", " "])
    labels = spark.createDataFrame([(i, int(i < 160), 0) for i in range(0, 200, 2)] + [(None, 1, 0), (5000, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.resample_quality(df, labels).collect()}
    assert len(got) == 203
    assert all(got[i] for i in range(160)) and not any(got[i] for i in range(160, 200))
    assert all(got[i] for i in range(200, 203))


def brute_weights(texts, good):
    """Log weights with counts in dictionaries, of every text, from the n-grams' definition."""
    from collections import Counter
    from math import log

    import xxhash

    def mixed(x):
        x &= (1 << 64) - 1
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
        return x ^ x >> 31

    marks = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c != "_")

    def grams(text):
        core, shape = [], []
        for w in (x.decode() for x in text.encode().split()):
            left = w.lstrip(marks)
            body = left.rstrip(marks)
            head, tail = w[: len(w) - len(left)], left[len(body) :]
            case = "l" if body.islower() else "u" if body.isupper() and len(body) > 1 else "c"
            case = case if body.isalpha() else "d" if body.isdigit() else "m" if body else "p"
            core.append(xxhash.xxh3_64_intdigest(body.lower().encode()))
            shape.append(xxhash.xxh3_64_intdigest(f"{head}|{case}|{tail}".encode()))
        k = 0x9E3779B97F4A7C15
        out = [("w", mixed(c + 1) >> 52) for c in core] + [("s", mixed(s + 3) >> 50) for s in shape]
        for i in range(1, len(core)):
            out.append(("w", mixed(core[i - 1] * k + core[i] + 2) >> 52))
            out.append(("s", mixed((shape[i - 1] * k + shape[i]) * 2 + (core[i] == core[i - 1]) + 4) >> 50))
        return Counter(out)

    own = [grams(t or "") for t in texts]
    raw, target = sum(own, Counter()), sum((own[i] for i in good), Counter())
    out = []
    for i, g in enumerate(own):
        others = raw.total() - g.total()
        mine = g if i in good else Counter()
        due = (target.total() - mine.total()) / others
        out.append(sum(n * log((target[x] - mine[x] + 2) / ((raw[x] - n) * due + 2)) for x, n in g.items()))
    return out


def test_importance_weights_match_brute_force(spark):
    rng = np.random.default_rng(8)
    w = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(60)]
    texts = [" ".join(rng.choice(w, 30)).capitalize() + "." for _ in range(40)]
    texts += [" ".join(f"[{x.upper()}]1" for x in rng.choice(w, 50)) for _ in range(10)]
    texts += ["Same same SAME (same) 12 12!", "", "don't stop-it _x_ --", "a.b" * 30_000, "a" + "." * 100_000 + "b"]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(45, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.resample_quality(docs(spark, texts), labels, size=25).collect()}
    want = brute_weights(texts, set(range(20)))
    assert [got[i]["log_weight"] for i in range(len(texts))] == pytest.approx(want)
    kept = sorted(range(len(texts)), key=lambda i: -got[i]["key"])[:25]
    assert {i for i in got if got[i]["kept"]} == set(kept)


def test_sample_follows_the_weights(spark):
    import math

    n = 30_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.log(F.element_at(F.array(*map(F.lit, (1.0, 2.0, 5.0))), (F.col("id") % 3 + 1).cast("int"))).alias("log_weight"))
    keys = [(r["key"], r["doc_id"] % 3) for r in quality.gumbel_keys(df, 5).collect()]
    top = [c for _, c in sorted(keys, reverse=True)[:800]]
    for c, share in enumerate((1 / 8, 2 / 8, 5 / 8)):  # nearly, as the sample is small beside the table
        assert abs(top.count(c) - 800 * share) < 4 * math.sqrt(800 * share * (1 - share)) + 10
    again = [r["key"] for r in quality.gumbel_keys(df, 5).orderBy("doc_id").collect()]
    assert again == [k for k, _ in keys] or sorted(again) == sorted(k for k, _ in keys)


def test_quality_odd_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = docs(spark, ["a b", "c"])
    assert all(r["kept"] for r in quality.resample_quality(df, labels).collect())
    assert quality.resample_quality(df.limit(0), labels).count() == 0
    twice = quality.resample_quality(df.unionByName(df), labels).collect()
    assert len(twice) == 4


# pieces


def unigram_processor():
    """The public library's own unigram encoder, on the pieces and the scores that the operator uses."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(pieces.VOCABULARY, "rb").read())
    m.trainer_spec.model_type = 1
    own = {i: s for _, s, i in pieces.Vocabulary().pieces}
    for i, p in enumerate(m.pieces):
        if i in own:
            p.score = own[i]
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def test_scores_are_log_probabilities():
    import math

    own = pieces.Vocabulary().pieces
    assert sum(math.exp(s) for _, s, _ in own) == pytest.approx(1, abs=1e-3)
    assert pieces.unigram_scores([-1.5, -2.0]) == [-1.5, -2.0]


def test_encoding_matches_a_unigram_processor(spark):
    import sentencepiece

    sp = unigram_processor()
    texts = ["Hello world, this is  a test.", "naïve 🙂 日本語 ½ ²", "tab\tnew\nline ", *ODD[1:], "word " * 50, "<|x|> == foo_bar(1);", " lead", "ab " * 3]
    texts.append("The quick brown fox jumps over the lazy dog, unbelievably.")
    out = pieces.decode(pieces.encode(docs(spark, texts))).collect()
    for r in out:
        t = texts[r["doc_id"]]
        assert r["round_trip"] and r["decoded"] == t and r["n_pieces"] == len(r["ids"])
        assert r["ids"] == (sp.encode(t) if t else [])
    # words of an ordinary sentence come out as the file's own merges give them
    last = next(r for r in out if r["doc_id"] == len(texts) - 1)
    assert last["ids"] == sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY).encode(texts[-1])


def test_encoding_odd_tables(spark):
    df = docs(spark, [None, "", "▁", "y" * 5000, "same", "same"])
    got = {r["doc_id"]: r for r in pieces.encode(df).collect()}
    assert got[0]["n_pieces"] == got[1]["n_pieces"] == 0 and not got[2]["round_trip"] and got[3]["round_trip"]
    assert got[4]["ids"] == got[5]["ids"]
    assert pieces.encode(df.limit(0)).count() == 0


def test_encoding_of_long_runs_matches_a_unigram_processor(spark):
    import base64

    sp = unigram_processor()
    rng = np.random.default_rng(5)
    letters = "".join(rng.choice(list("etaoinshrdlu"), 2000))
    texts = [
        "日本語の文章は空白なしで続くことが多い" * 20,
        "ภาษาไทยเขียนติดกันโดยไม่เว้นวรรค" * 12,
        base64.b64encode(rng.bytes(600)).decode(),
        letters,
        "internationalization" * 30,
        "=" * 613,
        "🙂½" * 200,
        " " * 700 + "x" * 300,
        "y" * 255, "y" * 256, "y" * 257, "y" * 5000,
        f"short {letters} words  between {letters} and\n{'-' * 300}\n",
    ]
    out = pieces.encode(docs(spark, texts)).collect()
    assert len(out) == len(texts)
    for r in out:
        assert r["round_trip"] and r["ids"] == sp.encode(texts[r["doc_id"]])


def test_lattices_folded_together_match_paths_one_by_one():
    """Ties go to the smaller start; a character without a piece costs the unknown score."""
    v = pieces.Vocabulary()
    v.pieces = [(t, s, i) for i, (t, s) in enumerate([("a", -2.0), ("b", -2.0), ("ab", -4.0), ("aba", -5.0), ("ba", -3.0), ("bb", -5.5)])]
    v.unknown_score = -15.5
    ids = {t: i for t, _, i in v.pieces}
    rng = np.random.default_rng(2)
    units = ["".join(rng.choice(list("abc"), n)) for n in rng.integers(1, 40, 300)]
    edges, count = [], []
    for u in units:
        own = [(b, a, ids.get(u[a:b], -1 - ord(u[a]))) for a in range(len(u)) for b in range(a + 1, len(u) + 1) if u[a:b] in ids or b == a + 1]
        edges += [(b << pieces.END) + (a << pieces.START) + i + pieces.LOWEST for b, a, i in rng.permutation(own).tolist()]
        count.append(len(own))
    flat, length = pieces.viterbi(np.array(edges), np.array(count), np.array([s for _, s, _ in v.pieces]), v.unknown_score)
    got = [x.tolist() for x in np.split(flat, np.cumsum(length)[:-1])]
    known = pieces.Paths(v)
    known.bytes = np.arange(256) + 1000
    assert [[i if i >= 0 else 1000 - 1 - i for i in x] for x in got] == [known.ids(u) for u in units]


def test_blocks_shuffle_numbers_of_words(spark):
    """Neither words nor texts are in what a block's documents bring to the shuffle, and small blocks give the same ids."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("etaoinshrdlu"), n)) for n in rng.integers(4, 12, 3000)]
    texts = [" ".join(rng.choice(words, 200)) + "." for _ in range(300)] + [None, "", "two  spaces", "z" * 600, "\u2581x"]
    df = docs(spark, texts).coalesce(1).cache()
    whole = sum(len(t.encode()) for t in texts if t)
    rows = pieces.number_words(df.select("doc_id", "text"), pieces.Vocabulary()).collect()
    assert sum(len(r["data"]) for r in rows) < 0.3 * whole
    one = {r["doc_id"]: (r["ids"], r["round_trip"]) for r in pieces.encode(df).collect()}
    many = {r["doc_id"]: (r["ids"], r["round_trip"]) for r in pieces.encode(df, block_chars=20_000).collect()}
    assert one == many and len(one) == len(texts) and [k for k, (_, same) in one.items() if not same] == [len(texts) - 1]


def test_lattice_rows_stay_in_order_and_are_not_grouped_again(spark, monkeypatch):
    """One shuffle deals the units out; edges are told apart by order, whatever the lots."""
    v = pieces.Vocabulary()
    ids, rng = {t: i for t, _, i in v.pieces}, np.random.default_rng(5)
    places = {}
    for place in rng.permutation(900).tolist():
        unit = pieces.SPACE + "".join(rng.choice(list("aenst🙂"), rng.integers(0, 5)))
        places.setdefault(unit, []).append((3 << 32) + place)
    listed = spark.createDataFrame([(u, p) for u, own in places.items() for p in own], "unit string, place long")
    made = pieces.lattice(listed, v)
    assert "Aggregate" not in made._jdf.queryExecution().executedPlan().toString()
    batches = made.coalesce(1).toArrow().to_batches()
    monkeypatch.setattr(pieces, "LOT", 100)
    got = {}
    for lot in pieces.whole_units(small for b in batches for i in range(0, b.num_rows, 7) for small in [b.slice(i, 7)]):
        edges, count, place, unit = pieces.split(lot)
        for k, own in enumerate(np.split(edges, np.cumsum(count)[:-1])):
            got[tuple(sorted(place[unit == k].tolist()))] = sorted(own.tolist())
    edge = lambda u, a, b: (b << pieces.END) + (a << pieces.START) + ids.get(u[a:b], -1 - ord(u[a])) + pieces.LOWEST
    assert got == {
        tuple(sorted(own)): sorted(
            edge(u, a, b) for a in range(len(u)) for b in range(a + 1, len(u) + 1) if u[a:b] in ids or b == a + 1
        )
        for u, own in places.items()
    }


@pytest.mark.parametrize("odd", [True, False])
def test_words_of_a_block_divided_together_match_words_one_by_one(odd):
    """Without a look-up for each word and unit in Python; texts with spaces in a row are one word."""
    texts = ["a b, c", "x", "a\n_b² é", "tail", "b, a", "z.z ² c", "b, zz"]
    if odd:
        texts[1:1] = ["", " lead  two", "tail ", None, "  ", " lead  two", "q  r", " "]
    block = pieces.BlockWords(pa.array(texts))
    words, units = {}, {}
    flat = [words.setdefault(w, len(words)) for t in texts for w in pieces.words_of(t)]
    made = [units.setdefault(u, len(units)) for w in words for u in pieces.units_of(w)]
    assert block.sizes.tolist() == [len(pieces.words_of(t)) for t in texts] and block.word.tolist() == flat
    assert block.units.to_pylist() == list(units) and block.made.tolist() == made
    assert block.parts.tolist() == [len(pieces.units_of(w)) for w in words]
    none = pieces.BlockWords(pa.array([None, ""], pa.string()))
    assert [len(x) for x in (none.word, none.units, none.made, none.parts)] == [0, 0, 0, 0] and none.sizes.tolist() == [0, 0]
