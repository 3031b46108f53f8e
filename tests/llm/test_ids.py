"""Every operator over ids of other types than long."""

from decimal import Decimal

import public_tokenizers
import pytest
from pyspark.sql import types as T
from quarry.llm import chunked_bpe, imatch, language_id, packing, rlbwt_dedup, simhash, suffix_tree_lm, superkmer_dedup, weak_quality

TEXTS = ["the cat sat on the mat and the dog ran", "der Hund und die Katze über den Berg", "the cat sat on the mat and the dog ran", None, "", "short", "the dog sat"]
KINDS = [(T.IntegerType(), int), (T.ShortType(), int), (T.StringType(), lambda k: f"id{k}"), (T.DecimalType(20, 0), Decimal)]
OPERATORS = {
    "op1": lambda d: language_id.predict(d, language_id.fit(d)),
    "op2": lambda d: imatch.fingerprint_documents(d, [b"the", b"cat"]),
    "op3": lambda d: chunked_bpe.digest_documents(d, public_tokenizers.path("byte_bpe_50k.json")),
    "op4": lambda d: rlbwt_dedup.remove_repeats(d, 10),
    "op5": lambda d: packing.pack_documents(d, public_tokenizers.path("word_bpe_49k.json")),
    "op6": lambda d: simhash.components(simhash.fingerprints(d)),
    "op7": lambda d: superkmer_dedup.remove_repeats(d, 3),
    "op8": lambda d: weak_quality.predict(d, weak_quality.fit(d)),
    "op9": lambda d: suffix_tree_lm.score(d, "true"),
    "near": simhash.near_groups,
}


@pytest.mark.parametrize("kind", KINDS, ids=lambda k: k[0].simpleString())
@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op7"])
def test_ids_of_any_type(spark, kind, name):
    check(spark, kind, name)


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"op1", "op2", "op3", "op7"}))
def test_int_ids(spark, name):
    check(spark, KINDS[0], name)


def check(spark, kind, name):
    schema = T.StructType([T.StructField("doc_id", kind[0]), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n", T.StringType())])
    rows = [(kind[1](k), t, "de" if k == 1 else "en", "x") for k, t in enumerate(TEXTS)]
    found = OPERATORS[name](spark.createDataFrame(rows, schema))
    assert found.schema["doc_id"].dataType == kind[0]
    assert sorted(r.doc_id for r in found.collect()) == sorted(r[0] for r in rows)
