"""Small tables with nulls, empty and long texts, ties, repeats, odd columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, hash string, key string, copies string, kept string, component_id string, text_key string"


def words(rng, n, alphabet="abcdefghijklmnop"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(n))


def rows(seed=1):
    rng = random.Random(seed)
    out = []

    def add(text, lang="en", source="s1"):
        out.append((len(out) + 1, text, lang, source))

    add(None)
    add("")
    add("   \n\t ")
    add("one two")
    add("One  TWO\n")
    add("one two", None, None)
    base = words(rng, 120)
    for _ in range(5):
        add(base, "en", "s2")
    for k in range(12):
        w = base.split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = "changed" + str(k)
        add(" ".join(w), "en", f"s{k % 7}")
    chain = words(rng, 200).split()
    for k in range(8):
        chain = chain[:]
        chain[k * 20] = f"step{k}"
        add(" ".join(chain), "de", "s3")
    add(words(rng, 20000), "en", "s4")
    add("x" * 70000, "en", "s4")
    add("a b c d e " * 40, "en", "s4")
    add("\n".join(["same line of boilerplate text here"] * 3 + ["other line that is long enough"]), "en", "s4")
    for k in range(8):
        add(f"unique line number {k} of this text\nshared boilerplate across sites\n{words(rng, 30)}", "fr", f"s{k}")
    for _ in range(30):
        add(words(rng, rng.randint(5, 80)), rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s0", "s5", "é", None]))
    add("Größe naïve    x\x1cy z\x85w \U0001f600\U0001f600 don't we'll 123abc ½٣  \n\n end", "de", "s9")
    return [(i, t, g, s, len(t) if t is not None else None, "x", "y", "z", "k", "c", "q", "ci", "tk") for i, t, g, s in out]


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def odd(spark):
    """Only odd rows: null ids, repeated rows, all columns null."""
    base = rows()
    nothing = (None,) * len(base[0])
    return spark.createDataFrame([nothing, nothing, base[3], base[3], base[7], base[7], (None, *base[8][1:])], SCHEMA)
