"""Toxic words that share a short stem and nothing else, known from few labels."""

import random

from lodestone.llm import toxicity


def test_short_stems_from_few_labels(spark):
    rng = random.Random(3)
    parts = ["ra", "li", "ton", "men", "os", "ber", "eau", "ich", "da", "gu", "fel", "nor"]
    rows, labels = [], []
    for d in range(1200):
        words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(40, 120))]
        if toxic := d % 9 == 0:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["vequ", "xaju"]) + "".join(rng.choices(parts, k=2)))
        rows.append((d, " ".join(words)))
        labels.append((d, int(toxic)))
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    toxic, clean = ([r["predicted"] for r in got if (r["doc_id"] % 9 == 0) == t] for t in (True, False))
    assert len(toxic) > 20 and sum(toxic) >= 0.95 * len(toxic) and sum(clean) <= 0.03 * len(clean)
