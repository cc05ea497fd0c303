"""Documents with everything that may turn up in a table."""

import random

CLASHING = ["kept", "key", "n_words", "group_size", "line", "tokens", "component", "ids", "block"]
CLASHING += ["id", "text_sha256", "stratum", "_stratum", "_symbols", "_dup_lines", "p_text", "row"]
CLASHING += ["number", "given 0", "label", "class", "chunk", "n_shingles", "base_failed", "symbols"]


def words(count, seed, vocabulary=200):
    chance = random.Random(seed)
    return [f"w{chance.randrange(vocabulary)}é"[: 2 + chance.randrange(4)] for _ in range(count)]


def odd_texts():
    long = " ".join(words(30_000, 1, 5000))
    lines = "\n".join(["  A shared line that is long enough. "] * 2 + ["own line of text number {}"])
    near = words(60, 2, 10_000)
    return [
        None,
        "",
        " \t\n\x0b ",
        "one",
        "same text, twice",
        "same text, twice",
        "Same Text, twice",
        "ends in newline\n",
        long,
        long,
        long[:-1] + "x",
        *[lines.format(i) for i in range(5)],
        "a shared line that is long enough.\r\nand another one\n\n",
        " ".join(near),
        " ".join(near[:-1] + ["other"]),
        " ".join(["changed"] + near[1:]),
        " ".join(near[30:] + near[:30]),
        "é" * 50 + " ▁ <|endoftext|>   é ΑΣ 梦 \U0001f600",
        "tab\tseparated\x0bwords\x0chere " * 20,
    ]


def odd_documents(spark, repeat=True):
    """(doc_id, text, lang, source, n_chars) and columns whose names operators use themselves."""
    rows = [
        (i * 3 % 101, text, [None, "en", "de"][i % 3], f"s{i % 2}", None if text is None else len(text))
        for i, text in enumerate(odd_texts())
    ]
    rows.append((None, "a document without an id", None, None, None))
    if repeat:
        rows += rows[3:6] + [(rows[8][0], "another text under a known id", "en", "s1", 30)]
    named = ", ".join(f"`{name}` string" for name in CLASHING)
    return spark.createDataFrame(
        [(*row, *[f"{name} {i}" for name in CLASHING]) for i, row in enumerate(rows)],
        f"doc_id bigint, text string, lang string, source string, n_chars bigint, {named}",
    ).repartition(3)


def collected(frame, *names):
    return sorted(map(tuple, frame.select(*names).collect()), key=repr)


def texts_of(docs):
    return [tuple(row) for row in docs.select("doc_id", "text").collect()]


def moved_bytes(frame):
    """Bytes that all exchanges of a query have written, without what it stored on the way."""

    def walk(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if name.endswith("QueryStage"):
            return walk(plan.plan())
        own = plan.metrics().get("dataSize").get().value() if name == "Exchange" else 0
        children = plan.children()
        return own + sum(walk(children.apply(at)) for at in range(children.size()))

    frame.collect()
    return walk(frame._jdf.queryExecution().executedPlan())
