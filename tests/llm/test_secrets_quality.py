from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from umbra.llm import quality, registry, secrets

KINDS = ["assign", "access", "hex"]


def base_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in registry.op5_secrets(spark, small).collect():
        want = base_spans(texts[r.doc_id])
        said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("guess")) == said


def test_base_spans_of_odd_texts():
    rng = random.Random(2)
    parts = ["password", "PassWd", "=", ":", " ", '"', "'", "abc", "ABCDEF", "AKIA", "0123456789abcdef", "f" * 9, "token", "API_KEY", "apikey", "é", "\n", "AKIAAKIA", "-", "s3cr3t"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        got = [(a, KINDS.index(k), b) for k, a, b, _ in secrets.find_spans(text) if k != "guess"]
        assert got == base_spans(text), text


def test_guess_costs():
    cost = secrets.log10_guesses
    assert cost("") == 0
    assert cost("password") < cost("Passw0rd") < cost("xkqwzvbn")
    assert cost("qwertyuiop") < 4 and cost("aaaaaaaaaaaa") < 4 and cost("19991231") < 6 and cost("abcabcabcabc") < 6
    assert cost("x7#Kq9$Lm2!v") > 12
    assert cost("a" * 5000) > 0


def brute_cost(value, words_path=None):
    """The cheapest segmentation, from the definitions: every span is tried, and every way to read it."""
    import functools

    costs = secrets.word_costs(words_path)

    def char(c):
        return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)

    def is_date(s):
        full = re.fullmatch(r"((?:19|20)\d\d)([-/._]?)(\d\d)\2(\d\d)", s)
        if full and 1 <= int(full[3]) <= 12 and 1 <= int(full[4]) <= 31:
            return True
        other = re.fullmatch(r"(\d\d)([-/._]?)(\d\d)\2((?:19|20)?\d\d)", s)
        return bool(other and 1 <= int(other[1]) <= 31 and 1 <= int(other[3]) <= 12)

    def ways(s):
        if len(s) == 1:
            yield char(s)
        low = s.lower()
        for word in (low, "".join(secrets.LEET.get(c, c) for c in low)):
            if word in costs:
                yield costs[word] + (math.log10(2) if s != word else 0)
        if len(s) >= 3 and all(any(a + b in row or a + b in row[::-1] for row in secrets.KEY_ROWS) for a, b in zip(low, low[1:])):
            yield math.log10(47 * 2 * len(s))
        for unit in range(1, len(s) // 2 + 1):
            if len(s) >= 3 and len(s) % unit == 0 and s == s[:unit] * (len(s) // unit):
                yield sum(map(char, s[:unit])) + math.log10(len(s) // unit)
        if re.fullmatch(r"(?:19|20)\d\d", s):
            yield math.log10(200)
        if is_date(s):
            yield math.log10(365 * 200)

    @functools.cache
    def best(i):
        if i == len(value):
            return 0.0
        return min((w + best(j) for j in range(i + 1, len(value) + 1) for w in ways(value[i:j])), default=math.inf)

    return best(0)


def test_costs_against_all_segmentations():
    path = public_tokenizers.path(registry.WORDS)
    rng = random.Random(3)
    parts = ["password", "Dr4gon", "qwerty", "asdf", "1999", "20010203", "aaa", "xyxy", "7", "#", "Z", "k", "sunshine", "fr@nce", "schule", "654"]
    for k in range(300):
        value = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) + "".join(rng.choice("ab1#") for _ in range(rng.randint(0, 5)))
        for words in (None, path):
            got, want = secrets.log10_guesses(value, words), brute_cost(value, words)
            assert got >= want - 1e-9 and (abs(got - want) < 1e-9 or any(c.isdigit() for c in value)), (value, got, want)


def test_word_ranks_tell_words_from_generated_values():
    path = public_tokenizers.path(registry.WORDS)
    human = ["butterfly7x", "dragonmonkey", "MeinHund2019", "bonjour123", "contrasena", "Summer2024!", "letmein99", "iloveparis", "welcomehome1", "schmetterling", "horsebattery", "parisfrance75", "password1234"]
    made = ["x7Kq9Lm2vPzW", "kQzXvWmTrLpN", "G8#tq!Lr0pZv", "xkqwzvbnplrt", "9fK2mQx7Lp4Z", "qZ7xW2vK9mTb", "hGt5Rw8Yk3Nq", "zXcV9bNm1QwE7r"]
    assert sum(secrets.log10_guesses(v, path) >= secrets.MIN_LOG10_GUESSES for v in human) <= 2
    assert all(secrets.log10_guesses(v, path) >= secrets.MIN_LOG10_GUESSES for v in made)


def test_added_spans_are_costly_and_new():
    text = 'pwd = "x7#Kq9$Lm2!v" and pwd: password123 and passphrase=summerflower password=abcdef99'
    spans = secrets.find_spans(text)
    assert [(k, text[a:b]) for k, a, b, _ in spans if k == "guess"] == [("guess", "x7#Kq9$Lm2!v")]


def test_values_past_a_base_span_and_of_letters():
    text = "password = Tr0ub4dor&3-horse!X9 and pwd: kQzXvWmTrLpN, but password=Tr0ub4dor3horseX9 and pwd: dragonmonkey"
    spans = secrets.find_spans(text)
    assert [text[a:b] for k, a, b, _ in spans if k == "guess"] == ["Tr0ub4dor&3-horse!X9", "kQzXvWmTrLpN"]
    found = [dict(zip(("kind", "start", "end", "log10_guesses"), s, strict=True)) for s in spans]
    assert secrets.replace_spans(text, found) == "[assign] and pwd: [guess], but [assign] and pwd: dragonmonkey"


def test_long_repeats_and_walks_are_one_pattern():
    cost = secrets.log10_guesses
    assert abs(cost("*" * 96) - (math.log10(33) + math.log10(96))) < 1e-9
    assert abs(cost("x7#Kq" * 9) - (cost("x7#Kq") + math.log10(9))) < 1e-9 and abs(cost("qw" * 60) - math.log10(94 * 120)) < 1e-9
    assert abs(cost("ab#" * 2 + "monkey") - (cost("ab#") + math.log10(2) + cost("monkey"))) < 1e-9
    assert [k for k, *_ in secrets.find_spans("pwd: " + "*" * 300)] == []


def test_mask(odd, empty, odd_rows):
    got = secrets.mask(odd).collect()
    assert len(got) == len(odd_rows) and secrets.mask(empty).count() == 0
    row = next(r for r in got if r.doc_id is None)
    assert row.text == "a text without an id, [assign] and more words here" and row.n_chars == len(row.text)
    assert sorted(str(r.text) for r in got if r.doc_id is not None) == sorted(str(t) for i, t, _ in odd_rows if i is not None)
    assert secrets.scan(odd).count() == len(odd_rows) and secrets.scan(empty).count() == 0


def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed)


def test_statistics(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = registry.op6_quality(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_stats(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_statistics_of_odd_rows(odd, odd_rows, empty):
    got = sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in quality.judge(odd).collect())
    assert got == sorted(str((i, *brute_stats(t or ""))) for i, t, _ in odd_rows)
    assert quality.judge(empty).count() == quality.clean(empty).count() == 0


def brute_kept(rows, limit=20):
    """{row number: (lost words, kept, cleaned text)} from the definitions."""
    normal = lambda x: re.sub(r"[\t-\r ]+", " ", x.strip(" \t\n\x0b\x0c\r")).lower()
    held = Counter((h or "", n) for _, t, h in rows for n in {normal(x) for x in (t or "").split("\n")} if n)
    out = {}
    for i, (_, t, h) in enumerate(rows):
        gone = [x for x in (t or "").split("\n") if normal(x) and held[h or "", normal(x)] > limit]
        left = [x for x in (t or "").split("\n") if not normal(x) or held[h or "", normal(x)] <= limit]
        stats = brute_stats(t or "")
        lost = sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in gone)
        out[i] = (lost, not stats[5] and lost <= 0.5 * stats[0], "\n".join(left))
    return out


def hosts(seed=4, n=500):
    """Rows with null, clashing and repeated ids, null hosts and texts, a hot host, copies of a whole text."""
    rng = random.Random(seed)
    common = ["This Line is on every   page", "and this one too says nothing", "a third line\twith a tab in it"]
    copy = "\n".join(f"copied{k} " * 6 for k in range(6))
    rows = []
    for i in range(n):
        lines = [" ".join(f"own{i}x{k}y{j}" for k in range(rng.randint(1, 12))) for j in range(rng.randint(0, 6))]
        lines += [rng.choice([str, str.lower, str.upper])(x) for x in common if rng.random() < 0.25] + [""] * rng.randint(0, 2)
        rng.shuffle(lines)
        text = copy if rng.random() < 0.08 else None if rng.random() < 0.02 else "\n".join(lines)
        rows.append((rng.choice([None, i, i % 7]), text, rng.choice(["hot", "hot", "a", "b", None])))
    return rows


def test_verdicts_against_the_definitions(spark):
    rows = hosts()
    want = brute_kept(rows)
    df = spark.createDataFrame([(i, t, h, -1, [0]) for i, t, h in rows], "doc_id long, text string, source string, n_chars long, __mine array<int>").repartition(5)
    for held in (1_000_000, 0):  # boilerplate lines in every worker, and joined
        got = quality.judge(df, most_held=held).collect()
        assert sorted((str(r.doc_id), r.n_lost_words, r.kept) for r in got) == sorted((str(rows[i][0]), lost, kept) for i, (lost, kept, _) in want.items())
        clean = quality.clean(df, most_held=held)
        assert clean.columns == df.columns
        said = sorted((str(r.doc_id), r.text, r.n_chars) for r in clean.collect())
        assert said == sorted((str(rows[i][0]), text, -1 if text == rows[i][1] else len(text)) for i, (_, kept, text) in want.items() if kept)


def test_copies_are_documents(spark):
    line = "a line that stands on every tenth page of a large host"
    rows = [(i, " ".join(f"own{i}x{k}" for k in range(30)) + f"\n{line}" * (i % 10 == 0), "h") for i in range(400)]
    rows += [(1000 + i, " ".join(f"copy{k}" for k in range(40)) + "\nits last line", "h") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert {i for i, r in got.items() if r.n_lost_words} == {*range(0, 400, 10), *range(1000, 1060)} and got[0].n_lost_words == len(line.split())
    assert all(r.kept == (i < 1000) for i, r in got.items())
    assert not any(line in r.text for r in quality.clean(df).collect())


def test_rows_of_one_id_are_judged_apart(spark):
    good = " ".join(f"good{k}" for k in range(30))
    df = spark.createDataFrame([(8, "short", "h"), (8, good, "h"), (None, "short", "h"), (None, good + " z", "h")], "doc_id long, text string, source string")
    assert sorted((str(r.doc_id), r.text) for r in quality.clean(df).collect()) == [("8", good), ("None", good + " z")]


def test_pipeline(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    before = {r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} < before
    first = spark.read.parquet(f"{small}/documents.parquet")
    assert all(stage(spark, first, small).columns == first.columns for _, stage in corpus_pipeline.STAGES[:-1])


def test_pipeline_of_odd_rows(odd, empty, spark):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, "").select(F.count("*")).first()[0] >= 0
    left = corpus_pipeline.near_duplicates(spark, odd, "").collect()
    assert sorted(str(r.doc_id) for r in left) == sorted(map(str, [1, 2, 3, 4, 5, 6, None, 7, 9]))
