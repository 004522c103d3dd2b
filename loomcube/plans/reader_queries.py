"""Queries of further readers: files are written from the tables to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomcube.operators import mapping
from loomcube.plans import tables as t
from loomcube.plans.source_queries import _lines, _path, _tabs, _text
from loomcube.sources import readers


def _valid_ids(spark, d):
    """Ids of the ontology's terms; alternative ids and other prefixes are none."""
    part = t.table(spark, d, "part")
    lines = part.select(F.format_string("[Term]\nid: %s:%d\nalt_id: GO:%d\nname: %s", F.when(F.col("p_size") > 10, "GO").otherwise("XX"), "p_partkey", F.col("p_partkey") + 1000000, "p_name").alias("value"))
    return readers.valid_ids(spark, _lines(spark, lines))


def _entity_variant(spark, d):
    """Pathways of another layout: entity, pathway and species in the columns 0, 3 and 7."""
    species = F.when(F.col("p_size") <= 25, " Homo Sapiens ").otherwise("Mus musculus")
    other = [F.lit("x")] * 2
    path = _tabs(spark, t.table(spark, d, "part"), _text("p_partkey", "P"), *other, "p_type", *other, F.lit("y"), species)
    return readers.read_pathways(spark, path, columns=(0, 3, 7))


def _pathway_names(spark, d):
    path = _tabs(spark, t.table(spark, d, "part"), F.format_string("R-HSA-%d", "p_partkey"), "p_name", F.lit("Homo sapiens"))
    return readers.read_pathway_names(spark, path)


def _ontology(spark, d):
    """Annotations by the names of their terms, of one namespace."""
    kinds = F.array(*map(F.lit, ("molecular_function", "biological_process", "cellular_component")))
    terms = t.table(spark, d, "part").select(F.format_string("[Term]\nid: P%d\nname: %s\nnamespace: %s", "p_partkey", "p_name", F.get(kinds, F.col("p_size") % 3)).alias("value"))
    notes = t.table(spark, d, "lineitem")
    path = _tabs(spark, notes, F.lit("db"), _text("l_suppkey", "S"), F.lit("sym"), F.lit("involved_in"), _text("l_partkey", "P"), *[F.lit("x")] * 12)
    return readers.ontology_bundle(spark, _lines(spark, terms, "\n\n"), path)["names_molecular_function"]


def _ids(spark, d):
    return readers.read_ids(spark, _lines(spark, t.table(spark, d, "documents").select(F.concat(F.lit(" "), "source", F.lit("\t")).alias("value"))))


def _resources(spark, d):
    """The mapping tables that two resources need, joined to one chain."""
    folder = _path(spark)
    orders, customer = t.table(spark, d, "orders"), t.table(spark, d, "customer")
    for name, rows in (("order2customer", orders.select(_text("o_orderkey", "O"), _text("o_custkey", "C"))), ("customer2nation", customer.select(_text("c_custkey", "C"), _text("c_nationkey", "N")))):
        rows.write.csv(f"{folder}/{name}", sep="\t")
    needed = {"orders": ["order2customer"], "nations": ["order2customer", "customer2nation"], "other": ["absent"]}
    maps = readers.load_resources(spark, folder, ["orders", "nations"], needed)
    return mapping.chain(maps["order2customer"], maps["customer2nation"])


QUERIES = {
    "src_valid_ids": _valid_ids,
    "src_pathway_variant": _entity_variant,
    "src_pathway_names": _pathway_names,
    "src_ontology_names": _ontology,
    "src_ids": _ids,
    "src_resource_chain": _resources,
}

SQL = {
    "src_valid_ids": "SELECT 'GO:' || p_partkey AS id FROM part WHERE p_size > 10",
    "src_pathway_variant": "SELECT DISTINCT 'P' || p_partkey AS entity, p_type AS pathway FROM part WHERE p_size <= 25",
    "src_pathway_names": "SELECT 'R-HSA-' || p_partkey AS id, p_name AS name FROM part",
    "src_ontology_names": "SELECT DISTINCT 'S' || l_suppkey AS entity, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 3 = 0",
    "src_ids": "SELECT DISTINCT source AS id FROM documents",
    "src_resource_chain": "SELECT DISTINCT 'O' || o_orderkey AS src, 'N' || c_nationkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey",
}
