"""Paragraphs that recur with small edits: the banding of problem 9.

A paragraph is its set of five-word shingles. Distinct paragraphs meet in tuned MinHash bands, their sketches are compared
bit-sliced, the exact Jaccard similarity decides, and connected components say which paragraphs are one; all but the first
of each are marked for removal. Exact spans are found by spans.py; how much of them this finds is in the README.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.neardup import components, similar_classes, word_sets, words_in_order
from quern.session import heavy, kept

#: Paragraphs with this similarity of their shingles are one; words of a shingle.
SIMILARITY, WORDS = 0.8, 5


def shingles(text: str, n: int = WORDS) -> set[str]:
    """Distinct runs of n words of the consistent form; a shorter text is one run."""
    words = words_in_order(text)
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def paragraphs_of(documents: DataFrame) -> DataFrame:
    """key (doc_id, para_no) and text of the paragraphs, parted by blank lines; those without a letter or digit are left out."""
    parts = F.split("text", r"\n\s*\n")
    p = documents.select("doc_id", F.posexplode(parts).alias("para_no", "text")).where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    return p.select(F.struct("doc_id", "para_no").alias("key"), "text")


def alike_paragraphs(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, para_no, first_doc, first_para, n_links of each paragraph that is alike to another: the first of its
    component, and how many other texts it is linked to directly.

    documents: doc_id, text; other columns are ignored. Null, empty and blank texts have no paragraphs; copies of a paragraph,
    also within one document, are one text. A pair of similarity 0.8 meets with probability 0.9999.
    """
    p = paragraphs_of(documents)
    sets = kept(word_sets(p, "key", ["text"], "text", shingles), "shingles")
    links = kept(similar_classes(sets, similarity), "paragraph-links")
    groups = components(links)
    degree = links.select("a").unionAll(links.select("b")).groupBy(F.col("a").alias("class")).agg(F.count("*").alias("n_links"))
    size = sets.groupBy("class").agg(F.count("*").alias("copies"), F.min("key").alias("key"))  # a row a text, whatever its copies
    each = size.join(groups.withColumnRenamed("node", "class"), "class", "left").withColumn("group", F.coalesce("group", "class"))
    first = each.groupBy("group").agg(F.min("key").alias("first"))
    classes = each.join(first, "group").join(degree, "class", "left").where((F.col("copies") > 1) | F.col("n_links").isNotNull())
    out = sets.select("key", "class").join(classes.select("class", "first", F.coalesce("n_links", F.lit(0)).alias("n_links")), "class")
    return out.select("key.doc_id", "key.para_no", F.col("first.doc_id").alias("first_doc"), F.col("first.para_no").alias("first_para"), "n_links")


def p9_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs that recur, with those to remove: all but the first of each component."""
    found = alike_paragraphs(heavy(spark, folder, "documents", "doc_id", "text").where("text is not null"))
    return found.withColumn("remove", (F.col("doc_id") != F.col("first_doc")) | (F.col("para_no") != F.col("first_para")))
