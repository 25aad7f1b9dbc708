"""Records are judged and typed without doing the work again for every use."""

from pricetrail.sources.identifier_files import map_headers, read_identifier_csv, type_import_lines


def test_blank_and_odd_records(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('sku;barcode;name\nA;1;x\n;;;beyond\n ; ;\n"""";;\n;;"two\nlines"\n"";"";""\n;é;\n00;7.0;\n#FORMULA;8;\n')
    rows = type_import_lines(map_headers(read_identifier_csv(spark, str(path)))).select("row_number", "sku", "barcode", "name", "error").collect()
    assert sorted(tuple(r) for r in rows) == [
        (2, "A", "1", "x", None), (5, '"', None, None, None), (6, None, None, "two\nlines", "sku and barcode are missing"), (8, None, "é", None, None),
        (9, "00", "7", None, None), (10, None, "8", None, "replace formulas by values")]


def test_identifiers_need_no_lambda(frame):
    typed = type_import_lines(frame("sku string, barcode string, name string", [("A", "1", "x")])).select("sku", "barcode", "name")
    assert "lambda" not in typed._jdf.queryExecution().optimizedPlan().toString()
