"""Registered queries read whole tables and whole texts: small fixtures by brute force."""

from millrace.plans import accounts, texts


def documents(spark, path, bodies):
    spark.createDataFrame(list(bodies.items()), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_layout_holds_every_document(spark, tmp_path):
    bodies = {i: " ".join(f"w{i}x{k}" for k in range(5 + 13 * i)) for i in range(12)}
    got = {}
    for r in texts.word_lines_layout(spark, documents(spark, tmp_path, bodies)).orderBy("doc", "page", "line").collect():
        got.setdefault(r["doc"], []).append(r["text"])
    assert {d: " ".join(t) for d, t in got.items()} == bodies


def events(spark, path, rows):
    spark.createDataFrame([(*r, "2024-01-01 00:00:00") for r in rows], "event_id long, user_id long, ts string").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_search_results_hold_every_event(spark, tmp_path):
    rows = [(i, i % 7) for i in range(150, 420)]
    got = accounts.search_results(spark, events(spark, tmp_path, rows)).collect()
    assert sorted(map(tuple, got)) == sorted((str(i), f"t{i}", f"https://x/{u}", 1, "s") for i, u in rows)


def test_heading_stack_holds_every_user(spark, tmp_path):
    rows = [(i, i * 7 % 40) for i in range(600)]
    stacks, want = {}, []
    for i, u in rows:
        stack = stacks.setdefault(u, {})
        if i % 4:
            for k in [k for k in stack if k >= i % 4]:
                del stack[k]
            stack[i % 4] = f"h{i}"
        want.append((u, i, ">".join(stack[k] for k in sorted(stack))))
    assert sorted(map(tuple, accounts.heading_stack(spark, events(spark, tmp_path, rows)).collect())) == sorted(want)


def test_code_fence_counts_the_whole_text(spark, tmp_path):
    bodies = {0: "a" * 30 + "`" * 9 + " b", 6: "plain", 13: "x " * 40 + "````", 4: "`" * 7}
    got = {r["doc_id"]: r["fence"] for r in texts.code_fences(spark, documents(spark, tmp_path, bodies)).collect()}
    assert got == {0: 10, 6: 3, 13: 5, 4: 8}


def test_overlap_counts_words_of_four_letters(spark, tmp_path):
    bodies = {1: "Some word here stands alone", 2: "some WORD and the rest", 3: "extraordinary circumstances"}
    items = {1: "some word here that", 2: "extraordinary thing with more", 3: "a of the"}
    sf = documents(spark, tmp_path, bodies)
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    long = lambda t: {w for w in t.lower().split() if len(w) >= 4}
    want = {(d, i, len(long(b) & long(t)), len(long(t))) for d, b in bodies.items() for i, t in items.items() if long(b) & long(t) and 2 * len(long(b) & long(t)) >= len(long(t))}
    assert want == {(1, 1, 3, 4), (2, 1, 2, 4)} and set(map(tuple, texts.benchmark_overlap(spark, sf).collect())) == want
