"""The three lifecycles from parameters to tables: expanded entity set, scores of categories, analysis and graph.

Each takes a parameter dataclass and a mapping of named input tables, and returns named result tables; nothing is
computed before a result is used. Every flag of the parameters takes effect here.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcube.config import Analysis, KnowledgeGraph, Preprocessing, TextMining
from loomcube.functions import text as x
from loomcube.operators import assoc, cube, expand, hierarchy, impute, kg, rank, score

Tables = Mapping[str, DataFrame]


def expand_entities(p: Preprocessing, tables: Tables) -> dict[str, DataFrame]:
    """``categories, core, entities, triples``.

    Tables: ``tree (code, name)``, ``ontology (parent, child)``, ``annotations (entity, term)``, ``reference (entity)``,
    and where their flag is set ``interactions (src, dst, score)``, ``members (pathway, entity)``,
    ``regulation (regulator, target)``. The core is what the terms and all below them annotate, with the entities
    named, as far as the reference knows them.
    """
    spark = tables["annotations"].sparkSession
    wanted = sorted({r for roots in p.categories for r in roots})
    codes = {r["code"] for r in tables["tree"].filter(F.col("code").isin(wanted)).select("code").collect()}
    every = tables["ontology"].select(F.explode(F.array("parent", "child")).alias("term")).unionByName(tables["annotations"].select("term"))
    terms = {r["term"] for r in every.filter(F.col("term").isin(list(p.terms))).distinct().collect()}
    if problems := p.problems(codes, terms):
        raise ValueError("; ".join(problems))
    roots = spark.createDataFrame([(a, r) for a, rs in zip(p.abbreviations, p.categories, strict=True) for r in rs], "category string, root string")
    chosen = spark.createDataFrame([(t,) for t in p.terms], "term string")
    named = spark.createDataFrame([(e,) for e in p.entities], "entity string")
    core = hierarchy.descendant_annotations(chosen, tables["ontology"], tables["annotations"]).unionByName(named).distinct()
    core = expand.of_reference(core, tables["reference"])
    added, triples = [], []
    if p.include_ppi:
        near, walked = expand.interaction_partners(tables["interactions"], core, p.ppi_hops, p.ppi_score)
        added, triples = [*added, near], [*triples, walked]
    if p.include_pathways:
        near, walked = expand.pathway_partners(tables["members"], core, p.pathway_count, p.pathway_share, p.pathway_mode)
        added, triples = [*added, near], [*triples, walked]
    if p.include_regulators:
        near, walked = expand.regulator_partners(tables["regulation"], core)
        added, triples = [*added, near], [*triples, walked]
    empty = core.limit(0).select(F.col("entity").alias("head"), F.lit("").alias("relation"), F.col("entity").alias("tail"), F.lit(1.0).alias("weight"))
    for t in triples:
        empty = empty.unionByName(t.select("head", "relation", "tail", "weight"))
    return {"categories": cube.prefix_assign(tables["tree"], roots, p.strict_prefix), "core": core, "entities": expand.expanded(core, *added), "triples": empty}


def mine_texts(p: TextMining, tables: Tables) -> dict[str, DataFrame]:
    """``cat_docs, counts, removed, entity_counts, scores, core_scores, synonym_ranks``.

    Tables: ``docs`` (``doc_id, year, terms`` and the fields of :data:`~loomcube.functions.text.FIELDS`),
    ``category_terms (category, term)``, ``synonyms (entity, synonym)``, ``core (entity)``, where flags ask for them
    ``category_synonyms (category, synonym)`` and ``lexicon (word)``, and with ``rerun_scoring`` the ``counts`` of an
    earlier run. Full text is searched only if it is included, in the sections that ``sections`` names.
    """
    docs = tables["docs"]
    doc_terms = docs.select("doc_id", F.explode("terms").alias("term"))
    cat_docs = cube.category_documents(doc_terms, tables["category_terms"])
    if p.include_label_imputation:
        labels = impute.impute(impute.select_mode(docs, "unlabelled"), tables["category_synonyms"])
        cat_docs = impute.extend_cube(cat_docs, labels)
    relevant = cube.relevant_documents(docs, cat_docs, p.first_year, p.last_year)
    cat_docs = cat_docs.join(relevant.select("doc_id"), "doc_id", "left_semi").select("category", "doc_id")
    synonyms = tables["synonyms"].select("entity", "synonym")
    if p.vary_case:
        synonyms = x.vary_case(synonyms, "synonym").select("entity", F.col("variant").alias("synonym"))
    synonyms = synonyms.select("entity", x.normalise_synonym(F.col("synonym")).alias("synonym")).filter("synonym <> ''").distinct()
    if p.rerun_scoring:
        counts = tables["counts"]
    else:
        counts = x.count_synonyms(relevant, synonyms.select("synonym"), text_columns=x.FIELDS[p.sections if p.include_full_text else "abstract"])
    removed = x.screen_synonyms(synonyms, tables["lexicon"]) if p.check_synonyms else None
    entity_counts = cube.entity_counts(counts, synonyms, removed)
    obs = cube.observations(cat_docs, entity_counts)
    out = {"cat_docs": cat_docs, "counts": counts, "entity_counts": entity_counts, "scores": score.score(obs), "core_scores": score.score_core(obs, tables["core"])}
    out["synonym_ranks"] = rank.ranked(cube.synonym_totals(counts, cat_docs), "category", "cnt", "synonym")
    return out if removed is None else out | {"removed": removed}


def analyse(p: Analysis, tables: Tables, n_categories: int) -> dict[str, dict[str, DataFrame]]:
    """An analysis of ``all`` entities, of the ``core``, or both, by name, as the flags say.

    Each holds ``z, sets, summary, cutoffs, pathways, means, members``. Tables: ``scores`` and ``core_scores
    (category, entity, score)``, ``synonyms (entity, synonyms)``, ``core (entity)`` and ``members (pathway, entity)``.
    If the flag says so, entities with equal synonyms and equal scores are analysed as one, whose name joins their
    ids; it belongs to the core if one of them does, and its synonyms are theirs.
    """
    if not (p.analyze_all_entities or p.analyze_core_entities):
        raise ValueError("neither all nor core entities are to be analysed")
    chosen = {"all": "scores"} if p.analyze_all_entities else {}
    chosen |= {"core": "core_scores"} if p.analyze_core_entities else {}
    return {name: _analysis(p, tables[source].select("category", "entity", "score"), tables, n_categories) for name, source in chosen.items()}


def _analysis(p: Analysis, scores: DataFrame, tables: Tables, n_categories: int) -> dict[str, DataFrame]:
    synonyms, core = tables["synonyms"].select("entity", "synonyms"), tables["core"].select("entity").distinct()
    if p.merge_entities:
        scores, members = assoc.merge_entities(scores, synonyms)
    else:
        members = scores.select("entity", F.col("entity").alias("member")).distinct()
        members = members.join(synonyms, "entity", "left").select("entity", "member", "synonyms")
    core = members.join(core.withColumnRenamed("entity", "member"), "member", "left_semi").select("entity").distinct()
    synonyms = members.groupBy("entity").agg(F.min("synonyms").alias("synonyms"))
    z = assoc.z_scores(scores)
    sets = assoc.entity_sets(z, p.z_threshold, core, n_categories)
    single = z.join(members.select("entity", "member"), "entity").select("category", F.col("member").alias("entity"), "z")
    return {
        "z": z, "sets": sets, "summary": assoc.summary_table(z, p.z_threshold, synonyms, n_categories),
        "cutoffs": assoc.cutoff_table(z, p.thresholds), "pathways": assoc.enrichment(tables["members"], sets),
        "means": assoc.pathway_means(tables["members"], single), "members": members,
    }


def build_graph(p: KnowledgeGraph, tables: Tables) -> dict[str, DataFrame]:
    """``edges, nodes`` from the sources that the flags choose and the scores, whose weights are ``weight``.

    Tables: ``scores``, and ``tree_edges (parent, child)``, ``tree (code, name)``, ``roots (category, root)``,
    ``members``, ``pathway_edges (parent, child)``, ``interactions``, ``regulation`` as the flags need them.
    """
    sources = {"score": kg.score_triples(tables["scores"], scale=p.weight)}
    if p.include_tree:
        sources["tree"] = kg.tree_triples(tables["tree_edges"], tables["tree"], tables["roots"])
    if p.include_pathways:
        sources["pathway"] = kg.pathway_triples(tables["members"])
        sources["hierarchy"] = kg.hierarchy_triples(tables["pathway_edges"])
    if p.include_ppi:
        sources["ppi"] = tables["interactions"].select(*kg.triple(F.col("src"), "binds_to", F.col("dst")))
    if p.include_regulators:
        sources["regulator"] = tables["regulation"].select(*kg.triple(F.col("regulator"), "targets", F.col("target"))).distinct()
    categories = tables["scores"].select("category").distinct()
    return {"edges": kg.assemble(sources), "nodes": kg.node_list(sources, categories)}
