import random
import re

import winsyn.llm.minhash_dedup as m


def brute(rows, width, percent=80):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), (c := least.get(root(i), d)), d is not None and c == d) for i, (d, _) in enumerate(rows)), key=str)


def sample(seed, n):
    rnd = random.Random(seed)
    vocab = ["w%d" % i for i in range(3000)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one\ttwo"), (5, "one two three"), (6, "x" * 5000), (None, "one two")]
    bases = [[rnd.choice(vocab) for _ in range(rnd.randint(5, 150))] for _ in range(12)]
    for k in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, max(1, len(w) // 25))):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((100 + k, (" " if k % 3 else "\n").join(w).upper() if k % 5 == 0 else " ".join(w)))
    rows += rows[20:40]
    rnd.shuffle(rows)
    return rows


def run(spark, rows, width):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, kept string")
    return sorted((tuple(r) for r in m.near_duplicates(df, width=width).drop("text_hash", "group").collect()), key=str)


def test_against_brute_force(spark):
    rows = sample(1, 250)
    assert run(spark, rows, 4) == brute(rows, 4)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 8)
    rows = sample(2, 150)
    assert run(spark, rows, 5) == brute(rows, 5)


def test_empty_table(spark):
    assert run(spark, [], 4) == []


def test_posterior_bound():
    least = m.least_matches(80, 1e-6)
    assert len(least) == 8 and all(0 <= x <= (k + 1) * 16 for k, x in enumerate(least)) and least == sorted(least)


def test_words_of_thue_and_morse_differ(spark):
    from winsyn.llm.minhash_dedup import near_duplicates

    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(df, width=4).collect()} == {1: 1, 2: 2, 3: 1}
