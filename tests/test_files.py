"""Readers and writers on small files: order over files of unequal size, odd cells, records."""

from litmine.sources import readers


def test_rows_are_numbered_by_file_and_place(spark, tmp_path):
    (tmp_path / "a.csv").write_text("DOI,n\n10.1/a,0\n,1\n10.1/b,2\n")
    (tmp_path / "b.csv").write_text("DOI,n\n" + "".join(f"10.1/{k},{k}\n" for k in range(3, 3000)))
    (tmp_path / "c.csv").write_text('DOI,n\n"10.1/x ""y"",\nz",3000\n')
    rows = readers.read_ner_csv(spark, str(tmp_path)).collect()
    assert len(rows) == 3000 and all(r.ord == int(r.n) for r in rows)
    assert next(r.DOI for r in rows if r.n == "3000") == '10.1/x "y",\nz'


def test_a_split_file_is_numbered_through(spark, tmp_path):
    (tmp_path / "z.tsv").write_text("".join(f"{k}\tname {k}\n" for k in range(5000)))
    (tmp_path / "y.tsv").write_text("x\tfirst\nw\t\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = readers.read_pubchem_bulk(spark, str(tmp_path), "title", 4).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 5001
    assert {r.ord: r.cid for r in rows} == {0: "x", **{k + 2: str(k) for k in range(5000)}}


def test_term_dictionary_and_curated_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿Term,Alias names\n Leaf ,blade\n# comment,\n,x\nRoot,\n")
    assert [tuple(r) for r in readers.read_term_dictionary(spark, str(tmp_path / "t.csv")).orderBy("ord").collect()] == [(0, "leaf", "blade"), (3, "root", None)]
    (tmp_path / "one.csv").write_text("Term\nLeaf\n")
    assert [tuple(r) for r in readers.read_term_dictionary(spark, str(tmp_path / "one.csv")).collect()] == [(0, "leaf", None)]
    (tmp_path / "c.csv").write_text("DOI number , Journal\n10.1/a,J\n ,K\n10.1/b,L\n")
    assert [(r.ord, r["DOI number"]) for r in readers.read_curated_rows(spark, str(tmp_path / "c.csv")).orderBy("ord").collect()] == [(0, "10.1/a"), (2, "10.1/b")]
    spark.createDataFrame([("10.1/p",), (None,)], "`DOI number` string").coalesce(1).write.parquet(str(tmp_path / "p.parquet"))
    assert [(r.ord, r["DOI number"]) for r in readers.read_curated_rows(spark, str(tmp_path / "p.parquet")).collect()] == [(0, "10.1/p")]


def test_dictionaries(spark, tmp_path):
    (tmp_path / "s.csv").write_text("scientific_name,scientific_name_input\nOcimum basilicum,x\n,Thymus vulgaris\n , \n")
    assert {r.scientific_name for r in readers.read_species_dictionary(readers.read_csv(spark, str(tmp_path / "s.csv"))).collect()} == {"Ocimum basilicum", "Thymus vulgaris"}
    (tmp_path / "c.csv").write_text("preferred_name,synonyms,smiles\nThymol,a|b,CC\n,x,\n")
    (row,) = readers.read_chemical_dictionary(readers.read_csv(spark, str(tmp_path / "c.csv"))).collect()
    assert (row.name, row.synonyms, row.smiles) == ("Thymol", "a|b", "CC")


def test_records_and_articles(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"pmcid": "PMC1", "pmid": "2", "doi": "https://doi.org/10.1/A", "title": " T ", "pubYear": "2001", "isOpenAccess": "y", "inEPMC": "N", "journalInfo": {"journal": {"title": "J"}}}\n{"id": "z"}\n')
    first, second = readers.read_epmc_records(spark, str(tmp_path / "e.json")).orderBy("id").collect()
    assert (first.id, first.doi.lower(), first.journal, first.is_open_access, first.has_full_text, first.authors) == ("PMC1", "10.1/a", "J", True, False, "Unknown authors")
    assert (second.id, second.citations, second.abstract) == ("z", 0, "")
    folder = tmp_path / "jats"
    folder.mkdir()
    (folder / "PMC7.xml").write_text("<article>\n<p>x</p></article>")
    (folder / "PMC8.nxml").write_text("<article/>")
    assert {tuple(r) for r in readers.read_jats_corpus(spark, str(folder)).collect()} == {("PMC7", "<article>\n<p>x</p></article>"), ("PMC8", "<article/>")}


def test_writers(spark, tmp_path):
    papers = spark.createDataFrame([(1, "10.1/a")], "id long, doi string")
    facts = spark.createDataFrame([(1, "A", "x", 2), (1, "B", None, 1)], "paper_id long, label string, canonical_text string, frequency long")
    for _ in range(2):  # a second write takes the first one's place
        readers.write_kb_tables(papers, facts, str(tmp_path / "kb"), 2)
    assert spark.read.parquet(str(tmp_path / "kb/papers")).count() == 1
    assert {(r.label, r.canonical_text, r.frequency) for r in spark.read.parquet(str(tmp_path / "kb/paper_entities")).collect()} == {("A", "x", 2), ("B", None, 1)}
    readers.write_eval_csv(spark.createDataFrame([("m", 0.123456, 3)], "system string, f1 double, n int"), str(tmp_path / "out"))
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "out")).collect()] == [("m", "0.1235", "3")]
