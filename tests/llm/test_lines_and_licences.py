from collections import Counter, defaultdict

from foliospark.llm import licences, line_dedup


def brute_lines(rows, min_sites):
    sites, first = defaultdict(set), {}
    key = lambda i: (i is not None, i or 0)
    for i, t, _, s, _ in rows:
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                sites[line].add(s or "")
                first[line] = min(first.get(line, (key(i), k, t)), (key(i), k, t))
    out = []
    for i, t, *_ in rows:
        kept = [x for k, x in enumerate((t or "").split("\n")) if not x.strip(" ") or len(sites[x]) < min_sites or first[x][:2] == (key(i), k)]
        out.append((i, None if t is None else "\n".join(kept)))
    return Counter(out)


def test_line_dedup_matches_brute_force(rows, docs, clashing, empty):
    for frame, least in ((docs, 8), (clashing, 3), (docs, 12)):
        found = line_dedup.dedup_lines(frame, min_sites=least)
        assert Counter((r.doc_id, r.text) for r in found.collect()) == brute_lines(rows, least)
        assert found.columns[:-1] == frame.columns
    assert line_dedup.dedup_lines(empty).count() == 0


NOTES = [
    ("Licensed under the Apache License, Version 2.0.", "apache"),
    ("some prose\nReleased under the MIT License.\nmore prose", "mit"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("x y z. Licensed under CC BY-NC 4.0. and then a lot of other words follow here", "cc"),
    ("All rights reserved.\nReleased under the MIT License.", "mit,proprietary"),
    ("He lost his driving license after the second version of the story.", ""),
    ("permission was granted to leave the copyright office", ""),
    ("no cue at all", ""),
    ("", ""),
    (None, ""),
]


def test_licence_families(spark, empty):
    frame = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(NOTES)] + [(0, NOTES[0][0], "x")], "doc_id bigint, text string, row string")
    found = licences.scan(frame).collect()
    assert Counter((r.doc_id, r.families) for r in found) == Counter([(i, f) for i, (_, f) in enumerate(NOTES)] + [(0, "apache")])
    assert {r.doc_id: r.n_paragraphs for r in found}[1] == 3
    assert licences.scan(empty).count() == 0


def test_licence_scores_match_a_plain_version(spark, docs):
    import numpy as np

    classes, weights, bias, temperature = licences.fitted()
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NOTES)], "doc_id bigint, text string")
    for r in licences.scan_paragraphs(frame).where("cued").collect():
        ws = licences.words((NOTES[r.id][0] or "").split("\n")[r.pos])
        z = np.array(bias) + sum((np.array(weights[g]) for g in licences.grams(ws) if g in weights), np.zeros(len(classes)))
        p = licences.softmax(z / temperature)
        assert abs(r.probability - p.max()) < 1e-3
        assert r.family == (classes[p.argmax()] if p.max() >= licences.LEAST else licences.UNKNOWN)
    assert licences.scan(docs).count() == docs.count()


MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights'
WRAPPED = [
    ("This text is available under CC BY-SA 4.0.", "cc", 1),
    (MIT, "mit", 1),
    ("prose before\n\n# " + MIT.replace("\n", "\n# ") + "\nprose behind", "mit", 1),
    ("Licensed under\nCC BY-NC 4.0. This Source Code Form is subject to the\nterms of the Mozilla Public License, v. 2.0. More words.", "cc,mpl", 2),
    ("Released under the MIT License.\nReleased under the MIT License.", "mit", 2),
    ("Licensed under\n\nCC BY-NC 4.0.", "cc", 1),  # its last line has three of the five triples
    ("This Source Code Form is subject\n \t\nto the terms of the Mozilla\n\nPublic License, v. 2.0.", "", 0),
]


def test_notices_without_cue_and_wrapped_notices(spark):
    frame = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(WRAPPED)], "doc_id bigint, text string")
    found = sorted(licences.scan(frame).collect())
    assert [(r.families, r.n_licence, r.n_paragraphs) for r in found] == [(f, n, t.count("\n") + 1) for t, f, n in WRAPPED]
