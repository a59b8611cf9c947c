"""Licence sentences and rules against a plain scan."""

import re

from floodframe.llm import licences as L
from floodframe.llm.common import prepare

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MIT = [s for s, i in L.SENTENCES.items() if i in ("mit-grant", "mit-notice", "as-is")]


def brute(text):
    text = re.sub(r"[.!?;:]+([ \t\r\n]|\Z)", "\n", (text or "").translate(UPPER))
    ids = [L.SENTENCES.get(re.sub(r"[^a-z0-9.]+", " ", s).strip(" ")) for s in text.split("\n")]
    ids = [i for i in ids if i]
    left, names = list(ids), set()
    for name, sequence in L.RULES:
        at = 0
        while at + len(sequence) <= len(left):
            if tuple(left[at:at + len(sequence)]) == sequence:
                left[at:at + len(sequence)] = [None]
                names.add(name)
            at += 1
    return len(ids), "".join(f"<{i}>" for i in ids), ",".join(sorted(names)), sum(i is not None for i in left)


TEXTS = [
    None, "", "plain text.", "Prose here.\nLicensed under the Apache License, Version 2.0.", "Released under the MIT License", "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.", "licensed under the GNU Lesser General Public License, version 2.1 or later; more",
    ".\n".join(MIT) + ".", MIT[0] + ".", MIT[1] + ". " + MIT[2], ". ".join(MIT).upper() + ". x. All rights reserved.", "é Released  under\tthe MIT License!? ü", "x " * 200_000 + ".\nReleased under the MIT License.",
]


def test_matches_plain_scan(spark):
    prepare(spark)
    rows = [(i, t, "l") for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], "l"), (4, TEXTS[4], "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licences string")
    got = sorted((tuple(r) for r in L.scan_licences(docs).collect()), key=str)
    assert got == sorted(((d, *brute(t)) for d, t, _ in rows), key=str)
    assert got[8][3] == "MIT" and L.scan_licences(docs.limit(0)).count() == 0


def test_sample_table(spark):
    docs = prepare(spark).read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {tuple(r) for r in L.scan_licences(docs).collect()}
    assert got == {(r["doc_id"], *brute(r["text"])) for r in docs.collect()}
    assert sum(bool(r[3]) for r in got) > 5
