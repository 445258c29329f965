"""op10 learns from every trusted document, not from a sample of each language."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spanforge.llm import kneserney, wholeney
from spanforge.llm.langid import held_out
from spanforge.llm.wordstats import Tokens


def test_the_model_is_that_of_all_trusted_text(spark, monkeypatch):
    monkeypatch.setattr(wholeney, "BATCH_BYTES", 20_000)
    monkeypatch.setattr(wholeney, "ROWS", 700)
    rng = np.random.default_rng(5)
    words = [f"w{int(x) ** 2 // 900}" for x in rng.integers(0, 900, 60_000)]
    texts = [" ".join(words[20 * i : 20 * i + int(rng.integers(1, 21))]) for i in range(3000)]
    texts[7], texts[8], texts[9] = None, "", "spam spam spam spam ODD 42"
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 9 > 0), 0) for i in range(2900)], "doc_id long, quality int, toxic int")
    steady = kneserney._steady(Tokens(pa.array(texts), lower=False))
    learned = docs.join(labels.where("quality = 1"), "doc_id").select("doc_id", "text", "lang", held_out(docs["doc_id"], 5, 0).alias("apart"))
    learned = learned.where(F.col("doc_id").isin([i for i in range(3000) if steady[i]]) & F.col("text").isNotNull())
    assert learned.where("NOT apart").count() > 1.5 * kneserney.PER_LANG
    model = kneserney.fit(learned)
    got = {r.doc_id: r for r in kneserney.judged(docs, labels, ["doc_id", "lang"]).collect()}
    want, n, _ = model.perplexity(pa.array(texts))
    assert len(got) == 3000 and [got[i].n_tokens for i in range(3000)] == n.tolist()
    assert np.allclose([got[i].perplexity for i in range(3000)], want, rtol=1e-4)
    rest = sorted(got[r.doc_id].perplexity for r in learned.where("apart").collect())
    assert np.isclose(got[0].threshold, rest[int(np.ceil(0.99 * len(rest))) - 1] * kneserney.SLACK)
    kept = {r.doc_id for r in kneserney.accepted(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r.kept} and len(kept) < 3000
