"""A corpus pipeline over documents: each stage works on all that the one before it kept.

Toxic documents go, then those that the quality rules reject; one document of each group of near-duplicates stays; the
sources are mixed to their target weights, which repeats documents; the rest is packed into sequences. Every stage but
the last returns the columns of documents. Empty, null and repeated rows are handled as each operator's module states.
"""

from __future__ import annotations

from rasterloom.llm import mixing, near_text, packing, quality, toxicity
from rasterloom.llm.common import table
from rasterloom.llm.registry import byte_bpe


def drop_toxic(spark, docs, sf_dir):
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def apply_quality_rules(spark, docs, sf_dir):
    return quality.keep_good(docs, quality.learn(quality.labelled_rows(docs, table(spark, sf_dir, "labels"))))


def drop_near_duplicates(spark, docs, sf_dir):
    return near_text.keep_one(docs)


def mix_sources(spark, docs, sf_dir):
    return mixing.mix(docs)


def pack_sequences(spark, docs, sf_dir):
    return packing.pack_documents(docs, byte_bpe())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", apply_quality_rules),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]
ORACLE_SQL = None


def _remove(spark, path):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def run(spark, sf_dir):
    """The rows of the last stage. Each stage's rows are written as Parquet into the shared folder and read back; what a stage has read is removed once its own rows are written."""
    import uuid

    from rasterloom.llm.common import shared_folder

    docs, read = table(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{number}"
            docs.write.parquet(path)
            if read:
                _remove(spark, read)
            docs, read = spark.read.parquet(path), path
    return docs
