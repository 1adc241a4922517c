"""Benchmark items of fewer words than a window, inside longer documents."""

from aeroframe.llm import decontaminate


def test_short_items_inside_longer_documents(spark):
    bench = spark.createDataFrame([(1, "why is grass green"), (2, "What is 7 times 8"), (3, "how many legs has spider 8"), (4, "short item"), (5, "Rome Paris 10")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "he asked them why is grass green? and nobody knew"), (2, "x why is grass green why is grass green"), (3, "so tell me What is 7 times 8 now"), (4, "so tell me What is 9 times 3 now"),
        (5, "one two how many legs has"), (6, "one two how many legs has spider 9 and more"), (7, "a short item inside of a text"), (8, "to Oslo Bari 11 we go by train"), (9, "to Rome Paris 10 we go by train"),
        (10, "oh why is grass green"), (11, "why is grass"), (12, "why is grass green")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.changed, r.n_covered, r.n_windows) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(1, 1, False, 4, 1), (2, 1, False, 4, 1), (3, 2, False, 5, 1), (6, 3, True, 6, 1), (9, 5, False, 3, 1), (10, 1, False, 4, 1), (12, 1, False, 4, 1)]
