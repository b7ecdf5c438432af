"""The windows that count as toxic must stay clean as the sample grows: with
very many windows, some are by chance in toxic sentences only."""

import numpy as np

from postlens.llm import toxicity


def test_chance_windows_do_not_drown_the_insults(spark):
    rng = np.random.default_rng(0)
    syllables = ["the", "an", "er", "ing", "on", "re", "st", "ou", "nd", "ha"]
    insults = ["moron", "scumbag", "clownish"]

    def sentence():
        return " ".join("".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(9))

    rows = []
    for i in range(3000):
        toxic = i % 8 == 0
        parts = [sentence() for _ in range(6)]
        if toxic:
            parts[int(rng.integers(6))] += " " + str(rng.choice(insults))
        rows.append((i, ". ".join(parts) + ".", int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic").where("doc_id < 2400"))
    assert min(machine.decide(insults)) > 0 > max(machine.decide(["the", "ering", "handre"]))
    got = toxicity.score_documents(docs, machine).join(docs, "doc_id").where("doc_id >= 2400").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.97
