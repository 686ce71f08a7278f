from radiolens.llm.lines import dedup_lines


def brute(rows, long_words):
    docs = sorted({(i is None, i or 0, t) for i, t in rows if t is not None})
    seen = {}
    for no, i, t in docs:
        lines = t.split("\n")
        held = [k for k, x in enumerate(lines) if x.strip(" ")]
        for j in range(len(held)):
            for n in (1, 2, 3):
                run = held[j : j + n]
                body = [lines[k].strip(" ") for k in run]
                if len(run) == n and (n == 3 or sum(x.count(" ") + 1 for x in body) > long_words):
                    seen.setdefault("\n".join(body), []).append(((no, i, t), run[0], run[-1]))
    gone = {}
    for places in seen.values():
        places.sort(key=lambda p: p[0][:2] + p[1:])
        first = places[0]
        for doc, a, b in places[1:]:
            gone.setdefault(doc, set()).update(range(max(a, first[2] + 1) if doc == first[0] else a, b + 1))
    return {d: "\n".join(x for k, x in enumerate(d[2].split("\n")) if k not in gone.get(d, ())) for d in docs}, {d: len(gone.get(d, ())) for d in docs}


def test_lines_against_brute_force(docs_of):
    import random

    rng = random.Random(7)
    pool = [f"line {i} " + "w " * (i % 5 * 4) for i in range(14)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 15)))) for i in range(80)]
    rows += [(100, "\n".join(["same"] * 50)), (101, "word " * 60), (102, "before\n" + "word " * 60 + "\nafter"), (103, None), (104, "\n\n"),
             (105, "two " * 30 + "\n" + "lines " * 30), (106, "x\n" + "two " * 30 + "\n" + "lines " * 30 + "\ny"), (None, "same\nsame\nsame"), (3, rows[3][1]),
             (200, "\n".join(f"long {i}" for i in range(20_000))), (201, "\n".join(f"long {i}" for i in range(20_000)))]
    docs = docs_of(rows)
    out = dedup_lines(docs, long_words=20)
    assert out.columns == [*docs.columns, "n_removed"]
    texts, counts = brute(rows, 20)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text, r.n_removed) for r in out.where("text is not null").collect())
    assert got == sorted((i if i is not None else -1, texts[i is None, i or 0, t], counts[i is None, i or 0, t]) for i, t in rows if t is not None)
    assert out.where("doc_id = 103").first().text is None


def test_nothing_to_do(docs_of):
    assert dedup_lines(docs_of([])).count() == 0
    rows = dedup_lines(docs_of([(1, "a\nb"), (2, "a\nb")])).collect()
    assert [(r.text, r.n_removed) for r in rows] == [("a\nb", 0)] * 2
