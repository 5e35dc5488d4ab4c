"""A tiny world: six topics of two domains, and T8, outside the sample, which cites two of them."""

from driftnet.sources import readers

TRAIN = {"T1": {"T3": 3}, "T2": {"T2": 70, "T5": 2, "T8": 6}, "T3": {"T6": 2}, "T5": {"T8": 1, "T3": 7}}
BEFORE = {"T4": {"T1": 9}}
#: Counts of the years after, (cited, citing, n): T6's works cite T3 four times.
AFTER = [("T6", "T3", 1), ("T3", "T6", 4), ("T1", "T5", 3)]


def record(topic, freeze=2017, format=1, retrieved="2025-01-01", size=600, **other):
    first = freeze - 7
    row = {
        "format": format, "topic": topic, "freeze": freeze, "retrieved": retrieved, "train_window": [first, freeze], "recent_window": [freeze - 2, freeze], "size": size,
        "works_by_year": {str(first + i): 40 + 10 * i for i in range(8)}, "instrument": [f"W{7 * i}" for i in range(1, 4)], "usable_abstracts": 12,
        "cited_by_train": TRAIN.get(topic, {}), "cited_by_recent": {}, "cited_by_before": BEFORE.get(topic, {}), "record": f"{topic}-{retrieved}",
    } | other
    return tuple(row.values())


def records_frame(spark):
    return spark.createDataFrame([record(f"T{i}") for i in range(1, 7)], readers.RECORD + ", record string")


def topics_frame(spark):
    return spark.createDataFrame([(i, f"T{i}", "Life" if i < 4 else "Matter") for i in range(1, 7)], "pos int, id string, domain string")
