"""A small table of documents with every odd case, and plain versions of what the operators compute."""

import random
import re

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    T.StructField("node", T.StringType()), T.StructField("key", T.LongType()), T.StructField("n_words", T.IntegerType())])

_EN = "the of and to in that it with for was on as are by this from or had not but what all were when".split()
_DE = "der die und das nicht ist ein zu mit sich auf für eine im dem auch als an nach wie über können große".split()


def sentence(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def documents():
    rng = random.Random(5)
    rows = []
    vocabulary = {"en": [a + b for a in _EN for b in ["", *_EN[:6]]], "de": [a + b for a in _DE for b in ["", *_DE[:6]]]}
    for i in range(60):
        lang = "en" if i % 2 else "de"
        rows.append((i, sentence(rng, vocabulary[lang], rng.randint(8, 160)), lang))
    shared = sentence(rng, vocabulary["en"], 60)
    base = sentence(rng, vocabulary["en"], 120)
    for i in range(60, 70):  # near copies and a passage of 60 words in clean text
        words = base.split(" ")
        words[7 * (i - 59)] = f"changed{i}"
        rows.append((i, " ".join(words), "en"))
        rows.append((100 + i, sentence(rng, vocabulary["de"], 50) + " " + shared + "\n" + sentence(rng, vocabulary["de"], 30), "de"))
    rows += [(200 + i, rows[3][1], "en") for i in range(12)]  # exact copies
    rows += [(300, None, "en"), (301, "", "en"), (302, " \n\t ", None), (303, "Short one", "en"), (304, "Short one", "en"), (305, "12 345 !!", "en"), (306, "x", None)]
    rows += [(307, "wort " * 3000, "de"), (308, sentence(rng, vocabulary["en"], 4000), "en")]  # a repeat of itself, a long one
    rows += [(309, rows[5][1], "en"), (309, rows[5][1], "en"), (309, "Same id, other text entirely", "en"), (None, rows[9][1], "en"), (None, None, None)]
    rows += [(310, "Naïve Ünïcode ÉTAT 中文 " + sentence(rng, vocabulary["en"], 20), "en"), (311, "Licensed under the Apache License, Version 2.0. And GNU General Public License", "en")]
    rows.append((312, "in front " + item_texts()[0] + " behind " + sentence(rng, vocabulary["en"], 40), "en"))
    rows.append((313, item_texts()[1] + " " + sentence(rng, vocabulary["en"], 900), "en"))
    rows.append((314, "so short item here " + sentence(rng, vocabulary["de"], 30), "de"))
    return [(i, t, lang, "src0", len(t) if t else 0, "extra", 1, 2) for i, t, lang in rows]


def item_texts():
    rng = random.Random(9)
    return [sentence(rng, [f"b{k}q" for k in range(300)], 40), sentence(rng, [f"b{k}q" for k in range(300)], 25), "Short, ITEM!", "", None, "b1q"]


def items():
    return list(enumerate(item_texts())) + [(0, item_texts()[0])]


def frame(spark, rows=None):
    rows = documents() if rows is None else rows
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def spaced(text, low=True):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text) if low else text or "")


def answers(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
