"""Readers over small hand-made files, and parameters."""

import gzip
import hashlib
import json

import pytest

from loomcube import config
from loomcube.plans import source_queries
from loomcube.sources import readers, stages


@pytest.fixture
def put(tmp_path):
    def write(name, content):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return f"file://{path}"

    return write


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


ARTICLES = """<?xml version="1.0"?><PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID>11</PMID><Article><ArticleTitle>A title</ArticleTitle><Abstract><AbstractText>one</AbstractText><AbstractText>two</AbstractText></Abstract>
<AuthorList><Author><LastName>Doe</LastName><ForeName>J</ForeName></Author></AuthorList><Journal><Title>J</Title><JournalIssue><PubDate><Year>2001</Year></PubDate></JournalIssue></Journal></Article>
<MedlineJournalInfo><Country>X</Country></MedlineJournalInfo><MeshHeadingList><MeshHeading><DescriptorName>Heart</DescriptorName><QualifierName>injury</QualifierName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>12</PMID><Article><ArticleTitle>B</ArticleTitle><Abstract><AbstractText></AbstractText><AbstractText>two</AbstractText></Abstract><Journal><JournalIssue><PubDate><MedlineDate>1999 Jan</MedlineDate></PubDate></JournalIssue></Journal></Article></MedlineCitation></PubmedArticle>
<PubmedBookArticle><BookDocument><PMID>13</PMID><ArticleTitle>Book</ArticleTitle></BookDocument></PubmedBookArticle>
</PubmedArticleSet>"""


def test_articles(spark, put):
    got = readers.with_year(readers.read_articles_xml(spark, put("a.xml", ARTICLES)))
    by = {r["PMID"]: r for r in got.collect()}
    assert set(by) == {"11", "12", "13"}
    assert by["11"]["Abstract"] == "one\ntwo" and by["12"]["Abstract"] == "" and by["11"]["MeshHeadingList"] == ["Heart", "injury"]
    assert (by["11"]["year"], by["12"]["year"], by["13"]["year"]) == (2001, 1999, -1)
    assert by["11"]["AuthorList"][0]["LastName"] == "Doe" and by["11"]["Country"] == "X"
    assert readers.documents_per_file(got).first()["n_documents"] == 3


def test_articles_json(spark, put):
    line = json.dumps({"PMID": "1", "ArticleTitle": "t", "MeshHeadingList": ["a"]})
    assert readers.read_articles_json(spark, put("a.json", line + "\n")).first()["MeshHeadingList"] == ["a"]


def test_full_text(spark, put):
    xml = '<x><article><article-id pub-id-type="pmid">5</article-id><article-id pub-id-type="pmc">PMC7</article-id><body><p>some <b>text</b></p></body></article></x>'
    assert rows(readers.read_full_text_xml(spark, put("f.xml", xml)), "pmid", "pmcid", "body") == [("5", "7", "some text")]


def test_digests(spark, put, tmp_path):
    data = gzip.compress(b"hello")
    put("d/a.gz", data)
    put("d/a.gz.md5", f"MD5(a.gz)= {hashlib.md5(data).hexdigest()}\n")
    put("d/b.gz", data)
    put("d/b.gz.md5", "0" * 32)
    assert rows(readers.verify_digests(spark, f"file://{tmp_path}/d"), "file", "ok") == [("a.gz", True), ("b.gz", False)]


OBO = "format-version: 1.2\n\n[Term]\nid: GO:1\nname: top: level\nnamespace: biological_process\n\n[Term]\nid: GO:2\nalt_id: GO:9\nname: low\nnamespace: biological_process\nis_a: GO:1 ! top\nrelationship: part_of GO:3 ! other\nrelationship: regulates GO:4 ! no\n"


def test_ontology(spark, put):
    path = put("g.obo", OBO)
    obo = readers.read_obo(spark, path)
    assert rows(readers.obo_terms(obo), "id", "name") == [("GO:1", "top: level"), ("GO:2", "low")]
    assert rows(readers.obo_edges(obo), "parent", "child") == [("GO:1", "GO:2"), ("GO:3", "GO:2")]
    assert rows(readers.valid_ids(spark, path), "id") == [("GO:1",), ("GO:2",)]
    gaf = put("a.gaf", "!comment\nDB\tP1\tsym\tinvolved_in\tGO:1\nDB\tP2\tsym\tNOT|involved_in\tGO:2\n")
    assert readers.read_gaf(spark, gaf).count() == 2 and readers.read_gaf(spark, gaf, negated=False).count() == 1
    bundle = readers.ontology_bundle(spark, path, gaf)
    assert rows(bundle["names_biological_process"], "entity", "name") == [("P1", "top: level"), ("P2", "low")]


def test_descriptors_and_tree(spark, put):
    xml = "<S><DescriptorRecord><DescriptorUI>D1</DescriptorUI><DescriptorName><String>Heart</String></DescriptorName><TreeNumberList><TreeNumber>C14.2</TreeNumber><TreeNumber>A1</TreeNumber></TreeNumberList></DescriptorRecord></S>"
    tree = readers.read_descriptors_xml(spark, put("d.xml", xml))
    assert rows(tree, "id", "name", "code") == [("D1", "Heart", "C14.2")] and readers.tree_problems(tree).count() == 0
    assert rows(readers.read_tree(spark, put("t.bin", "Heart;C14.2\n")), "term", "code") == [("Heart", "C14.2")]


def test_tables(spark, put):
    pathways = readers.read_pathways(spark, put("p.tsv", "P1-2\tR1\tu\tn\te\tHomo sapiens\nP1\tR1\tu\tn\te\tHomo sapiens\nP2\tR2\tu\tn\te\tMus musculus\n"))
    sets = readers.pathway_sets(pathways)
    assert rows(sets, "pathway", "entities", "size") == [("R1", ["P1"], 1)] and readers.size_statistics(sets).first()["median"] == 1
    assert readers.pathway_sets(pathways, merge_isoforms=False).first()["size"] == 2
    assert rows(readers.read_pathway_hierarchy(spark, put("h.tsv", "R-HSA-1\tR-HSA-2\nR-HSA-1\tR-MMU-2\n")), "parent", "child") == [("R-HSA-1", "R-HSA-2")]
    assert rows(readers.read_regulators(spark, put("r.tsv", "tf\tgene\tx\ty\tz\tConfidence\nA\tB\t\t\t\tHigh\nA\tC\t\t\t\tLow\n")), "tf_gene", "target_gene") == [("A", "B")]
    assert rows(readers.read_fasta_ids(spark, put("f.fa", ">sp|P1|N\nSEQ\n>sp|P2|M\n")), "entity") == [("P1",), ("P2",)]
    ppi = "query_ensp\tquery_name\tpartner_ensp\tpartner_name\tcombined_score\n9606.A\ta\t9606.B\tb\t0.9\n9606.A\ta\t9606.C\tc\t0.1\n"
    assert rows(readers.read_interactions(spark, put("i.tsv", ppi), threshold=0.5), "src", "dst") == [("9606.A", "9606.B")]


def test_interactions_of_a_taxon_begin_with_it(spark, put):
    ids = ("10090.9606", "10090.19606", "96060.A", "9606.B")
    lines = [f"{a}\ta\t{b}\tb\t0.9" for a, b in ((*ids[:1], "9606.C"), (ids[1], "9606.C"), (ids[2], "9606.C"), ("9606.C", ids[0]), (ids[3], "9606.C"))]
    ppi = "\n".join(["query_ensp\tquery_name\tpartner_ensp\tpartner_name\tcombined_score", *lines, ""])
    assert rows(readers.read_interactions(spark, put("taxa.tsv", ppi)), "src", "dst") == [("9606.B", "9606.C")]


def test_id_map(spark, put):
    text = "from_db\tfrom_id\tto_db\tto_id\treviewed\ttaxon\ngene\tG\tprot\tP1\ttrue\t9606\ngene\tG\tprot\tP2\tfalse\t9606\n"
    table = readers.read_id_map(spark, put("m.tsv", text))
    assert rows(readers.id_map(table, "gene", "prot"), "src", "dst") == [("G", "P1")]
    assert readers.id_map(table, "gene", "prot", reviewed=None, taxa=["9606"]).count() == 2


def test_lexicons_and_counts(spark, put):
    assert rows(readers.read_entity_synonyms(spark, put("e.json", json.dumps({"P_1": ["heart", "x"]}))), "entity", "synonym") == [("P_1", "P 1"), ("P_1", "heart"), ("P_1", "x")]
    assert rows(readers.read_synonym_lines(spark, put("s.txt", "P1|a|b\n")), "synonym") == [("P1",), ("a",), ("b",)]
    assert rows(readers.read_entity_counts(spark, put("c.txt", "77 a|2 b|3\n78 \n")), "doc_id", "entity", "cnt") == [("77", "a", 2), ("77", "b", 3)]
    assert rows(readers.read_category_roots(spark, put("k.txt", "C1 C2\nC3\n"), ["x", "y"]), "category", "root") == [("x", "C1"), ("x", "C2"), ("y", "C3")]
    assert rows(readers.read_document_categories(spark, put("d.json", '[["5", 0], ["6", 1]]')), "doc_id", "cat_num") == [("5", 0), ("6", 1)]


def test_names(spark, put):
    record = {"primaryAccession": "P1", "proteinDescription": {"recommendedName": {"fullName": {"value": "Full"}, "shortNames": [{"value": "S"}]}, "alternativeNames": [{"fullName": {"value": "Alt"}}]}, "genes": [{"geneName": {"value": "G"}}]}
    assert rows(readers.read_entity_names_json(spark, put("n.json", json.dumps(record))), "name") == [("Alt",), ("Full",), ("G",), ("S",)]


def test_clusters_and_records(spark, put):
    clusters = readers.read_uniref(spark, put("u.tsv", "U1\tP1; P2\nU2\tP1\n"))
    assert dict(rows(readers.clusters_by_entity(clusters), "entity", "clusters")) == {"P1": "U1; U2", "P2": "U1"}
    drugs = readers.read_tagged_records(spark, put("t.tsv", "D1\tNAME\tx\nD1\tSYN\ta\nD1\tSYN\tb\nD1\tZZ\tq\n"), ["NAME", "SYN"])
    assert drugs.first()["SYN"] == ["a", "b"]
    xml = '<d><drug><drugbank-id>DB1</drugbank-id><drugbank-id>X</drugbank-id><name>N</name><targets><target><id>T1</id><organism>Humans</organism></target><target><id>T2</id><organism>Mouse</organism></target></targets></drug></d>'
    assert rows(readers.read_drugs_xml(spark, put("dr.xml", xml)), "id", "targets") == [("DB1", ["T1"])]


def test_stage_builds_once(spark, tmp_path):
    path, calls = f"file://{tmp_path}/stage", []

    def build():
        calls.append(1)
        return spark.range(3)

    assert stages.stage(spark, path, build).count() == 3 and stages.stage(spark, path, build).count() == 3 and len(calls) == 1
    stages.stage(spark, path, build, refresh=True)
    assert len(calls) == 2 and stages.missing(spark, [path, path + "-none"]) == [path + "-none"]


def test_sinks(spark, tmp_path):
    df = spark.sql("SELECT 'a' AS head, 'r' AS relation, array('x', 'y') AS tail, 1.5D AS weight")
    stages.write_table(df, f"file://{tmp_path}/edges", "tsv")
    assert readers.read_graph(spark, f"file://{tmp_path}/edges", f"file://{tmp_path}/edges")[0].first()["tail"] == "x;y"


def test_parameters():
    text = "disease_list: C1 C2\ndisease_list: C3 C4\ninclude_ppi: True\nk: 2\nscore: 0.5\nname: abc\n"
    got = config.text_to_parameters(text)
    assert got == {"disease_list": [["C1", "C2"], ["C3", "C4"]], "include_ppi": True, "k": 2, "score": 0.5, "name": "abc"}
    assert config.text_to_parameters(config.parameters_to_text(got)) == got
    assert config.parse_categories("C1,C2 C3") == [["C1", "C2"], ["C3"]]
    assert config.unique_names(["a", "b", "a"]) == ["a", "b", "a_1"]
    assert config.valid_date("2020-02-29") and not config.valid_date("2021-02-29") and not config.valid_date("2021-2-1")
    own = config.from_text(config.Preprocessing, "include_ppi: yes\nppi_hops: 2\nterms: GO:1 GO:2\n")
    assert own.include_ppi and own.ppi_hops == 2 and own.problems(set(), {"GO:1"}) == ["unknown term GO:2"]
    with pytest.raises(ValueError):
        config.from_text(config.Preprocessing, "nonsense: 1\n")


def test_written_records_lie_in_several_files(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(source_queries, "XML_RECORDS", 2)
    monkeypatch.setattr(source_queries, "_path", lambda spark: f"file://{tmp_path}/drugs")
    frame([(i, f"n{i}", "b", "t", i) for i in range(7)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"file://{tmp_path}/part.parquet")
    assert source_queries._drugs(spark, f"file://{tmp_path}").count() == 7
    assert len(list((tmp_path / "drugs").glob("part-*"))) == 4
