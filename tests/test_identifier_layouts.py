"""Folders of identifier files whose layouts and line breaks differ."""

from pricetrail.sources.identifier_files import map_headers, read_identifier_csv, type_import_lines


def read(spark, folder, **files):
    for name, text in files.items():
        with open(folder / f"{name}.csv", "w", encoding="utf-8", newline="") as file:
            file.write(text)
    typed = type_import_lines(map_headers(read_identifier_csv(spark, str(folder))))
    return sorted((r.source_file, r.row_number, r.sku, r.barcode) for r in typed.collect())


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    got = read(spark, tmp_path, a="sku;ean\ns1;b1\ns2;b2\n", b="ean,sku\nb3,s3\n", c="sku;ean\r\n\r\ns4;b4\r\n")
    assert got == [("a.csv", 2, "s1", "b1"), ("a.csv", 3, "s2", "b2"), ("b.csv", 2, "s3", "b3"), ("c.csv", 3, "s4", "b4")]


def test_a_quoted_line_break_stays_in_its_cell(spark, tmp_path):
    text = 'sku;ean;name\ns1;b1;"two\nlines; ""quoted"""\ns2;b2;plain\n'
    assert read(spark, tmp_path, a=text) == [("a.csv", 2, "s1", "b1"), ("a.csv", 3, "s2", "b2")]
    rows = {r["sku"]: r["name"] for r in read_identifier_csv(spark, str(tmp_path)).collect()}
    assert rows == {"s1": 'two\nlines; "quoted"', "s2": "plain"}


def test_layouts_and_line_breaks_together(spark, tmp_path):
    folder = tmp_path / "with space"
    folder.mkdir()
    got = read(spark, folder, a='ean;sku;name\nb1;s1;"x\ny"\n', b="sku;ean\ns2;b2\n", c='ean;sku;name\n"b\n3";s3;z\n')
    assert [r[:3] for r in got] == [("a.csv", 2, "s1"), ("b.csv", 2, "s2"), ("c.csv", 2, "s3")] and got[1][3] == "b2"
