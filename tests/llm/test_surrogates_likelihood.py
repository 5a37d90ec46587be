from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from umbra.llm import likelihood, surrogates


def texts_of(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in surrogates.replace(df, key).collect()}


def luhn(n):
    d = [int(c) for c in re.sub(r"\D", "", n)][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def test_formats(spark):
    got = texts_of(spark, [
        "mail ann.b42@mail8.example.com now", "call +1 (988) 555-2485 or 988-555-2485.", "card 4111 1111 1111 1111 ok", "ssn 123-45-6789.",
        "ip 192.168.10.20 x", "iban DE89 3704 0044 0532 0130 00.", "Mrs Emma SMITH met Herr Jürgen Schmidt and г-жа Анна Иванова.", "Dear Emma Smith, and emma",
    ])
    t = {i: r.text for i, r in got.items()}
    assert re.fullmatch(r"mail [a-z]{3}\.[a-z]\d\d@[a-z]{4}\d\.[a-z]{7}\.com now", t[0]) and "ann" not in t[0]
    one, other = re.fullmatch(r"call \+1 \((\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4})\.", t[1]).groups()
    assert "2485" not in t[1] and one.replace(") ", "-") == other
    card = re.fullmatch(r"card (\d{4} \d{4} \d{4} \d{4}) ok", t[2])[1]
    assert luhn(card) and card[0] == "4" and card != "4111 1111 1111 1111"
    assert re.fullmatch(r"ssn 9\d\d-\d\d-\d{4}\.", t[3]) and re.fullmatch(r"ip 10(\.\d{1,3}){3} x", t[4])
    iban = re.fullmatch(r"iban (DE\d\d( \d{4}){4} \d\d)\.", t[5])[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and not iban.endswith("013000")
    assert re.fullmatch(r"Mrs ([A-Z][a-z]+) ([A-Z]+) met Herr ([A-Z][a-z]+) ([A-Z][a-z]+) and г-жа ([А-Я][а-я]+) ([А-Я][а-я]+)\.", t[6]), t[6]
    first, last = re.match(r"Mrs (\w+) (\w+)", t[6]).groups()
    assert t[7].startswith(f"Dear {first} {last.capitalize()},") and t[7].endswith("and emma")
    assert first[-2:] in surrogates.ENDINGS["latin"]["female"] and re.search(r"Herr \w+(ro|rd|ns) ", t[6])


def test_coreference_and_distinctness(spark):
    emails = [f"u{i % 50}@h{i % 7}.org" for i in range(600)]
    got = texts_of(spark, [f"x {e} y {e.upper()}" for e in emails])
    made = {}
    for i, e in enumerate(emails):
        a, b = re.fullmatch(r"x (\S+) y (\S+)", got[i].text).groups()
        assert a.lower() == b.lower() and made.setdefault(e, a) == a
    assert len(set(made.values())) == len(set(emails)) and not set(made.values()) & set(emails)


def test_persons_are_one_whatever_they_are_called(spark):
    got = texts_of(spark, [
        "Dr. Kim Lee met Mr. Kim Lee. Lee said so; Kim-Lee and Leeward did not.", "Emma went home", "Priya Sharma and Wei Zhang wrote to Ahmed Hassan.",
        "Prof Kim Lee", "王伟先生 and 김민수 씨", "My name is Xanthe Qorl, says Qorl. The Hall of Mirrors, New York", "Paris is lovely in May, Sir",
    ])
    t = {i: r.text for i, r in got.items()}
    a, b, c, d, e = re.fullmatch(r"Dr\. (\w+) (\w+) met Mr\. (\w+) (\w+)\. (\w+) said so; Kim-Lee and Leeward did not\.", t[0]).groups()
    assert a == c and b == d == e and "Kim" not in (a, b) and t[3] == f"Prof {a} {b}" and a[-2:] in surrogates.ENDINGS["latin"]["male"]
    assert re.fullmatch(r"[A-Z][a-z]+ went home", t[1]) and "Emma" not in t[1]
    assert not set(re.findall(r"\w+", t[2])) & {"Priya", "Sharma", "Wei", "Zhang", "Ahmed", "Hassan"} and re.fullmatch(r"\w+ \w+ and \w+ \w+ wrote to \w+ \w+\.", t[2])
    assert re.fullmatch(r"[\u4e00-\u9fff]+先生 and [가-힣]+ 씨", t[4]) and "王伟" not in t[4] and "김민수" not in t[4]
    who = re.fullmatch(r"My name is (\w+) (\w+), says (\w+)\. The Hall of Mirrors, New York", t[5]).groups()
    assert who[1] == who[2] != "Qorl" and t[6] == "Paris is lovely in May, Sir"


def test_phone_numbers_with_and_without_country(spark):
    got = texts_of(spark, ["+49 30 1234567 or (030) 123 4567", "+1 988-555-2485", "988-555-2485", "+44 988-555-2485"])
    digits = [re.sub(r"\D", "", got[i].text) for i in range(4)]
    assert digits[0][:2] == "49" and digits[1] == "1" + digits[2] and digits[3] == "44" + digits[2]
    one, other = got[0].text.split(" or ")
    assert re.sub(r"\D", "", one)[2:] == re.sub(r"\D", "", other)[1:] and other.startswith("(0") and "1234567" not in digits[0]


def test_surrogates_grow_where_a_format_has_too_few(spark):
    rows = [("phone", str(d), "") for d in range(10)] + [("ssn", str(d), "") for d in range(10)]
    made = surrogates.assign(spark.createDataFrame(rows, "kind string, value string, gender string"), "k").collect()
    assert len(made) == 20 and len({(r.kind, r.made) for r in made}) == 20 and not any(len(r.made) == 1 for r in made)


def test_against_texts_made_of_known_parts(spark):
    """A plain count of what goes where: entities at the places where they were put, equal values alike, all else untouched."""
    rng = random.Random(11)

    def entity():
        kind = rng.choice(["email", "ssn", "ip", "card", "person"])
        if kind == "email":
            return [(kind, rng.choice(["ann.b", "j_doe7", "x-y"]) + str(rng.randrange(30)) + "@" + rng.choice(["site.org", "mail.example.de"]))]
        if kind == "ssn":
            return [(kind, f"{rng.randrange(100, 120)}-45-6789")]
        if kind == "ip":
            return [(kind, f"10.1.{rng.randrange(20)}.7")]
        if kind == "card":
            body = "4" + "".join(rng.choice("01") for _ in range(14))
            digits = body + next(str(d) for d in range(10) if luhn(body + str(d)))
            return [(kind, rng.choice([digits, " ".join(digits[i : i + 4] for i in range(0, 16, 4))]))]
        return [("", rng.choice(["Mr ", "Dr. ", "Ms "])), ("first", rng.choice(["Quentin", "Yolanda"])), ("", " "), ("surname", rng.choice(["Okafor", "Lindqvist"]))]

    texts, truth = [], []
    for _ in range(150):
        parts = [("", "so ")]
        for _ in range(rng.randint(0, 5)):
            parts += [*entity(), ("", rng.choice([" é then ", ", 😀 and ", "\nlater "]))]
        texts.append("".join(p for _, p in parts))
        at, spans_ = 0, []
        for kind, p in parts:
            if kind:
                spans_.append((kind, at, at + len(p), p))
            at += len(p)
        truth.append(spans_)
    got, given = texts_of(spark, texts), {}
    for i, spans_ in enumerate(truth):
        assert [(e.kind, e.start, e.end) for e in got[i].entities] == [s[:3] for s in spans_], texts[i]
        left = re.escape(texts[i][: spans_[0][1]]) if spans_ else re.escape(texts[i])
        for (_, _, b, _), following in zip(spans_, [*spans_[1:], None], strict=False):
            left += "(.+?)" + re.escape(texts[i][b : following[1] if following else None])
        said = re.fullmatch(left, got[i].text, re.S)
        assert said, (texts[i], got[i].text)
        for (kind, _, _, p), new in zip(spans_, said.groups(), strict=True):
            plain = lambda x: re.sub("[ ]", "", x).lower()
            assert given.setdefault((kind, plain(p)), plain(new)) == plain(new) != plain(p) and len(new.split()) == len(p.split())
    made = [(k, v) for (k, _), v in given.items()]
    assert len(set(made)) == len(made) and not set(made) & set(given)


def test_collisions_are_resolved(spark):
    """One-letter addresses leave so few surrogates that many collide at first."""
    emails = [f"{a}@{b}.de" for a in "abcdefghijklmnopqrst" for b in "vwxyz"]
    got = texts_of(spark, emails)
    made = [got[i].text for i in range(len(emails))]
    assert len(set(made)) == len(made) and not set(made) & set(emails)


def test_key_and_repeatability(spark):
    texts = ["a@bc.org +49 30 1234 5678"]
    assert texts_of(spark, texts, "k")[0].text == texts_of(spark, texts, "k")[0].text != texts_of(spark, texts, "other")[0].text


def test_plan_is_native(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    done = surrogates.replace(df, "k")
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    before = {r.doc_id: r.text for r in df.collect()}
    for r in done.collect():
        for e in r.entities:
            part = before[r.doc_id][e.start : e.end]
            assert e.kind in ("first", "surname") or part not in r.text
        assert r.entities or r.text == before[r.doc_id]


def test_odd_surrogates(odd, odd_rows, empty):
    got = surrogates.replace(odd, "k").collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(str((i, t)) for i, t, _ in odd_rows)
    assert surrogates.replace(empty, "k").count() == 0


def test_gradient():
    """The step's direction is that of the numeric gradient."""
    rng = np.random.default_rng(0)
    net = likelihood.Network.start()
    net.weights[:] = net.weights.astype(np.float32)
    words, around = rng.integers(0, net.size, 40), rng.integers(0, net.size + 1, (40, 2 * likelihood.WINDOW))
    loss = lambda w: -likelihood.Network(w).log_probs(around, words).mean()
    weights = net.weights.astype(np.float64)
    wide = likelihood.Network(weights.copy())
    seen = np.zeros_like(weights)
    wide.train(around, words, seen)
    slope = np.sqrt(seen)
    for i in rng.choice(np.flatnonzero(slope > 1e-4), 12, replace=False):
        up, down = weights.copy(), weights.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        numeric = (loss(up) - loss(down)) / 2e-5
        assert abs(abs(numeric) - slope[i]) < 1e-3 * slope[i] + 1e-7 and np.sign(weights[i] - wide.weights[i]) == np.sign(numeric)


def test_runs_train_like_windows():
    rng = np.random.default_rng(4)
    ids, sizes = rng.integers(0, 4096, 300), np.array([0, 120, 1, 0, 2, 177])
    one, other = likelihood.Network.start(), likelihood.Network.start()
    seen, also = np.zeros_like(one.weights), np.zeros_like(one.weights)
    one.train(likelihood.windows(ids, sizes, np.arange(300)), ids, seen)
    run, at = likelihood.spaced(ids, sizes)
    other.train_run(np.concatenate([np.full(likelihood.WINDOW, one.size), run]), at + likelihood.WINDOW, also)
    assert np.allclose(seen, also, rtol=1e-3, atol=1e-12) and seen.any()


def texts_frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "__id long, __text string")


def test_every_place_is_trained(spark):
    """The class biases' step of the only batch is that of all places; over several rounds each place is still seen once."""
    texts = ["a b c d e f g h"] * 5 + ["", None, "i"] + ["z y x"] * 7
    docs = texts_frame(spark, texts)
    words = likelihood.frequent_words(docs)
    ids, sizes = likelihood.Vocabulary(words).number(pa.array([t or "" for t in texts], pa.large_string()))
    net = likelihood.Network.start()
    net.train(likelihood.windows(ids, sizes, np.arange(len(ids))), ids, np.zeros_like(net.weights))
    assert len(ids) == 62 and np.allclose(likelihood.fit(likelihood.number(docs, words, 1, rounds=1), 1), net.weights, atol=1e-3)
    dealt = likelihood.number(docs, words, 3).groupBy("__learner", "__round").agg(F.sum("__n").alias("n")).collect()
    assert sum(r.n for r in dealt) == 62 and len({r["__round"] for r in dealt}) > 1 and len({r["__learner"] for r in dealt}) == 3


def test_scores_do_not_depend_on_partitioning(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(rng.randint(0, 60)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, other = ({r.doc_id: r.log_likelihood for r in likelihood.score(d).collect()} for d in (df.coalesce(1), df.repartition(7, "text")))
    assert one.keys() == other.keys() and all(abs(one[i] - other[i]) <= 1e-6 * abs(one[i]) for i in one)


def test_runs_score_like_windows():
    rng = np.random.default_rng(7)
    net = likelihood.Network(rng.standard_normal(len(likelihood.Network.start().weights)).astype(np.float32) * 3)
    ids, sizes = rng.integers(0, 4096, 200), np.array([3, 0, 150, 1, 46])
    run, at = likelihood.spaced(ids, sizes)
    got = net.log_probs_run(np.concatenate([np.full(likelihood.WINDOW, net.size), run]), at + likelihood.WINDOW)
    assert np.allclose(got, net.log_probs(likelihood.windows(ids, sizes, np.arange(200)), ids), rtol=1e-3, atol=1e-3)


def test_log_probs_sum_to_one():
    net = likelihood.Network.start()
    around = np.zeros((net.size, 2 * likelihood.WINDOW), np.int64)
    assert abs(np.exp(net.log_probs(around, np.arange(net.size))).sum() - 1) < 1e-3


def test_learns_word_order(spark):
    rng = random.Random(1)
    chain = {w: rng.sample(range(40), 2) for w in range(40)}

    def text(shuffled):
        words, w = [], rng.randrange(40)
        for _ in range(120):
            words.append(f"w{w}")
            w = rng.choice(chain[w])
        if shuffled:
            rng.shuffle(words)
        return " ".join(words)

    train = spark.createDataFrame([(i, text(False)) for i in range(3000)], "doc_id long, text string").coalesce(2)
    held = spark.createDataFrame([(i, text(i % 2 == 1)) for i in range(200)], "doc_id long, text string")
    got = {r.doc_id: r.per_word for r in likelihood.score(held, trained_on=train).collect()}
    right = sum(got[i] > got[i + 1] for i in range(0, 200, 2))
    assert right >= 95


def brute_sum(weights, words, counts, text):
    """The definition, place by place, in plain Python and double precision."""
    net = likelihood.Network(weights.astype(np.float64))
    place = {w: i for i, w in enumerate(words)}
    bucket = {w: int(likelihood.bucket_ids(pa.array([w], pa.large_string()))[0]) for w in counts}
    in_bucket = Counter()
    for w, n in counts.items():
        if w not in place:
            in_bucket[bucket[w]] += n

    def id_of(w):
        return place[w] if w in place else int(likelihood.bucket_ids(pa.array([w], pa.large_string()))[0])

    said = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    ids = [net.size] * 3 + [id_of(w) for w in said] + [net.size] * 3
    total = 0.0
    for k, w in enumerate(said):
        around = ids[k : k + 3] + ids[k + 4 : k + 7]
        hidden = np.tanh(net.bias + sum(net.embed[a] * net.place[j] for j, a in enumerate(around)))
        class_, inner = divmod(ids[k + 3], likelihood.PER_CLASS)
        for logits, at in ((hidden @ net.to_class + net.class_bias, class_), (hidden @ net.to_word[class_] + net.word_bias[class_], inner)):
            total += logits[at] - math.log(sum(math.exp(x) for x in logits))
        if w not in place:
            total += math.log(max(1, counts.get(w, 1)) / (in_bucket[ids[k + 3]] + 1))
    return total


def test_sums_against_brute_force(spark):
    """All words, held counts and joined counts; a vocabulary that does not hold all words."""
    rng = random.Random(3)
    common = [f"c{i:04d}" for i in range(likelihood.CLASSES * likelihood.PER_CLASS - likelihood.BUCKETS)]
    rare = [f"r{rng.randrange(10**6)}ing" for _ in range(60)]
    texts = [" ".join(common)] * 40 + [" ".join(rng.choice(rare) if rng.random() < 0.4 else rng.choice(common) for _ in range(25)) for i in range(60)] + ["", "neverseen"]
    train = spark.createDataFrame(list(enumerate(texts[:-1])), "doc_id long, text string")
    counts = Counter(w for t in texts[:-1] for w in t.split())
    docs = train.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
    words = likelihood.frequent_words(docs)
    assert sorted(words) == sorted(common)
    weights = likelihood.fit(likelihood.number(docs, words, 1))
    held = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if i > 39], "doc_id long, text string")
    for most in (likelihood.HELD, 10):
        got = {r.doc_id: r for r in likelihood.score(held, trained_on=train, held=most).collect()}
        assert len(got) == len(texts) - 40 and got[len(texts) - 2].log_likelihood == 0 and got[len(texts) - 2].per_word is None
        for i, r in got.items():
            assert r.n_words == len(texts[i].split()) and abs(r.log_likelihood - brute_sum(weights, words, counts, texts[i])) < 1e-3 * max(1, r.n_words)


def test_odd_scores(odd, odd_rows, empty):
    got = likelihood.score(odd).collect()
    assert len(got) == len(odd_rows) and all(np.isfinite(r.log_likelihood) for r in got)
    assert likelihood.score(empty).count() == 0
