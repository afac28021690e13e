"""Column rules and table rules on small hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from anchorage.functions import columns as c
from anchorage.operators import clean, portfolio
from anchorage.sources import readers


def values(spark, rule, texts, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("v"))).collect()]


def test_parse_date_any(spark):
    texts = ["31/01/2024", "1-2-2024", "2024-02-03", "05.06.2023", "20240131", "31012024", "2024-13-01", "", None]
    assert values(spark, c.parse_date_any, texts) == [
        dt.date(2024, 1, 31),
        dt.date(2024, 2, 1),
        dt.date(2024, 2, 3),
        dt.date(2023, 6, 5),
        dt.date(2024, 1, 31),
        dt.date(2024, 1, 31),
        None,
        None,
        None,
    ]


def test_numbers(spark):
    assert values(spark, c.safe_num, ["1,5", "1,234,567", " 2 ", "1d", "x", "1e3", None]) == [1.5, None, 2.0, None, None, 1000.0, None]
    assert values(spark, c.numify_simple, ["1 234,5", "1 000", "-3", "a"]) == [1234.5, 1000.0, -3.0, None]
    assert values(spark, c.parse_money, ["$ 1,200.50", "-300", "", "1.2.3", None]) == [1200.5, 300.0, None, None, None]
    assert values(spark, lambda v: c.num_or(v, 7), ["1,000", "inf", "NaN", "", None]) == [1000.0, 7.0, 7.0, 7.0, 7.0]
    assert values(spark, lambda v: c.int_or(v, 100), ["25", "0", "-1", "2.9", "x", "1 000", "1,000", None]) == [25, 100, 100, 2, 100, 100, 1000, 100]


def test_codes(spark):
    assert values(spark, c.sex_bin, [" m", "F", "x", None]) == [1, 0, None, None]
    assert values(spark, c.yes_no_bin, ["sí", "y", "true", "no", None]) == [1, 1, None, 0, None]
    assert values(spark, lambda v: c.yes_no_bin(v, "table"), ["sí", "y", "true", "n", "false"]) == [1, None, 1, None, 0]
    assert values(spark, c.clean_cluster, ["-1", "999", " 3 ", "cluster 7", "a-2b5", "none", None]) == [999, 999, 3, 7, -2, None, None]
    assert values(spark, c.norm_group, [" activo ", "ACTIVOS", "Cancelado", "otro"]) == ["ACTIVO", "ACTIVO", "CANCELADO", None]


def test_pretty_feature_name(spark):
    names = ["Sexo_Cd_BIN", "prestaciones__PAC", "AFILIADO_ID_EPS", " TIPO  IPS_x "]
    assert values(spark, c.pretty_feature_name, names) == ["Sexo Cod. BIN", "Prestaciones PAC", "Afiliado ID EPS", "Tipo IPS X"]


def test_count_bands(spark):
    got = values(spark, c.bucket_0_1_2_5_6p, [None, -1.0, 0.0, 1.0, 1.5, 2.0, 5.0, 5.5, 6.0], "double")
    assert got == ["0", "0", "0", "1", None, "2 a 5", "2 a 5", None, "6+"]


def test_cut_is_right_closed(spark):
    got = values(spark, lambda v: c.cut(v, clean.AGE_EDGES, clean.AGE_LABELS), [0.0, 0.5, 20.0, 20.1, 100.0, 101.0, None], "double")
    assert got == [None, "0-20", "0-20", "20-30", "60+", None, None]


def test_months(spark):
    pairs = [("2024-01-31", "2024-03-15"), ("2024-01-15", "2024-03-15"), ("2024-05-01", "2024-04-01"), ("2024-02-10", "2024-02-25")]
    df = spark.createDataFrame(pairs, "a string, b string").select(F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    got = df.select(c.months_elapsed(F.col("a"), F.col("b")), c.months_frac(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [1, 2, 0, 0]
    assert [round(r[1], 6) for r in got] == [round(1 + 15 / 31, 6), 2.0, 0.0, round(15 / 29, 6)]


def test_date_plus_months_rounds_half_even(spark):
    start = F.lit("2024-01-01").cast("date")
    got = spark.range(1).select(*[c.date_plus_months(start, F.lit(m)) for m in (1, 8, 24)]).first()
    assert [(d - dt.date(2024, 1, 1)).days for d in got] == [30, 244, 730]


def test_clamp_keeps_missing(spark):
    assert values(spark, c.clamp01, [-1.0, 0.5, 2.0, None], "double") == [0.0, 0.5, 1.0, None]


def test_status_and_totals(spark):
    df = spark.createDataFrame([("CANCELADOS",), ("x",), (None,)], "FALLA string")
    assert [(r.ESTADO, r.is_cancel) for r in clean.add_status(df).collect()] == [("CANCELADOS", 1), ("ACTIVOS", 0), (None, None)]
    other = spark.createDataFrame([("CANCELADOS",)], "ESTADO string")
    assert clean.add_status(other).first().is_cancel == 1
    none = spark.createDataFrame([(1,)], "x int")
    assert clean.add_status(none).first().ESTADO is None
    assert clean.add_pqrs_total(none).first().pqrs_total is None
    assert clean.add_usage_total(none).first().consumos_total == 0.0
    final = spark.createDataFrame([(1.0, None, 5.0)], "Queja_PAC_FIN double, Peticion_PBS_FIN double, Felicitaciones_PAC double")
    assert clean.add_pqrs_total(final).first().pqrs_total == 1.0


def test_one_hot_and_undummy(spark):
    df = spark.createDataFrame([("A B",), ("C",), (None,)], "k string")
    hot = clean.one_hot(df, "k", "k_", ["A_B", "C"])
    assert [tuple(r)[1:] for r in hot.collect()] == [(1, 0), (0, 1), (0, 0)]
    back = clean.undummy(hot, "k_", "level")
    assert [r.level for r in back.collect()] == ["A_B", "C", "A_B"]


def test_drop_leakage(spark):
    names = ["AFILIADO_ID_EPS", "FECHA_FIN", "meses_transcurridos", "Queja_PAC_FIN", "FLAG_FRICCION_INICIAL"]
    names += ["GRUPO_CAUSA_CANCELACION_MORA", "GRUPO_CAUSA_CANCELACION", "PLAN"]
    df = spark.createDataFrame([tuple("x" * len(names))], names)
    assert clean.drop_leakage(df).columns == ["FLAG_FRICCION_INICIAL", "GRUPO_CAUSA_CANCELACION", "PLAN"]


def test_last_spell_open_end_wins(spark):
    df = spark.createDataFrame(
        [("a", 1, "2024-01-01"), ("a", 2, None), ("b", 3, "2024-05-01"), ("b", 4, "2024-05-01")],
        "AFILIADO_ID_EPS string, spell_id int, FECHA_FIN string",
    )
    got = {r.AFILIADO_ID_EPS: r.spell_id for r in clean.last_spell(df).collect()}
    assert got == {"a": 2, "b": 4}


def test_filters(spark):
    df = spark.createDataFrame([(" x", "critico"), ("y", "ALTO"), (None, None)], "PLAN string, grupo_operativo string")
    assert portfolio.apply_filters(df, {"PLAN": "x ", "grupo_operativo": "CRITICO"}).count() == 1
    assert portfolio.apply_filters(df, {"PLAN": "TODOS", "nope": "z", "grupo_operativo": None}).count() == 3
    assert portfolio.lookup(df.withColumnRenamed("PLAN", "AFILIADO_ID_EPS"), "  ").count() == 3


def test_lump_ties_by_name(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", "c", None, " "]], "v string")
    got = {r.grupo for r in portfolio.lump(df, "v", 3).collect()}
    assert got == {"(Sin dato)", "c", "a", "OTROS"}


def test_pyramid_bins(spark):
    df = spark.createDataFrame(
        [(0.0, "m", 1), (4.9, "M", 0), (5.0, "F", 1), (100.0, "f", 0), (101.0, "M", 1), (3.0, "", 1)],
        "EDAD_FECHA_FIN double, Sexo_Cd string, is_cancel int",
    )
    got = {r.edad_desde: (r.n_M, r.n_F, r.n_M_izq, r.tasa_M) for r in portfolio.pyramid(df).collect()}
    assert got == {0: (2, 0, -2, 0.5), 5: (0, 1, 0, 0.0), 95: (0, 1, 0, 0.0), None: (1, 0, -1, 1.0)}


@pytest.mark.parametrize(("line", "sep"), [("a;b,c", ";"), ("a,b;c", ";"), ("a\tb,c", "\t"), ("a,b,c;d", ","), ("a", ";")])
def test_detect_sep(line, sep):
    assert readers.detect_sep(line) == sep


def test_readers_guard_columns(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="AFILIADO_ID_EPS"):
        readers.read_permanence(spark, str(tmp_path / "p"))
    (tmp_path / "c.csv").write_text("ID, feature ,shap_value\n1,a,2\n")
    with pytest.raises(ValueError, match="feature_value"):
        readers.read_contrib(spark, str(tmp_path / "c.csv"))
    with pytest.raises(FileNotFoundError):
        readers.read_contrib(spark, str(tmp_path / "none.csv"))


def test_read_spells_text(spark, tmp_path):
    text = "AFILIADO_ID_EPS ;FECHA_INICIO;FECHA_FIN;EDAD_FECHA_FIN;PLAN\n1;31/12/2023;2024-05-01;33,5;ORO\n2;NULL;x;NA;null\n"
    (tmp_path / "s.csv").write_text(text)
    got = [tuple(r) for r in readers.read_spells(spark, str(tmp_path / "s.csv")).collect()]
    assert got == [("1", dt.date(2023, 12, 31), dt.date(2024, 5, 1), 33.5, "ORO"), ("2", None, None, None, None)]


def test_read_features_without_the_saved_index(spark, tmp_path):
    (tmp_path / "x.csv").write_text(",b,a\n7,1,2.5\n8,,x\n")
    got = readers.read_features(spark, str(tmp_path / "x.csv"), ["a", "b"])
    assert [tuple(r) for r in got.collect()] == [(2.5, 1.0), (None, None)]
    with pytest.raises(ValueError, match="c"):
        readers.read_features(spark, str(tmp_path / "x.csv"), ["a", "c"])


def test_write_lists_makes_one_set_per_list(spark, tmp_path):
    df = spark.createDataFrame([(1, "t"), (2, "c"), (3, "t")], "id int, Grupo string")
    readers.write_lists(df, str(tmp_path / "lists"))
    assert sorted(p.name for p in (tmp_path / "lists").iterdir() if p.is_dir()) == ["Grupo=c", "Grupo=t"]
    assert spark.read.csv(str(tmp_path / "lists"), header=True).count() == 3


def test_delimited_files_follow_their_quotes(spark, tmp_path):
    from anchorage.sources import readers

    (tmp_path / "a.csv").write_text('"AFILIADO_ID_EPS";"x;y";"FALLA"\n1;"a;""b""";SI\n')
    row = readers.read_delimited(spark, str(tmp_path / "a.csv")).first()
    assert row.asDict() == {"AFILIADO_ID_EPS": "1", "x;y": 'a;"b"', "FALLA": "SI"}
    (tmp_path / "b.csv").write_text('ID,feature,shap_value,feature_value\n1,"a\nb",0.5,1\n')
    assert readers.read_delimited(spark, str(tmp_path / "b.csv"), ",", multi_line=True).first().feature == "a\nb"
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        readers.read_delimited(spark, str(tmp_path / "b.csv"), ",").collect()


def test_files_with_other_column_orders_are_refused(spark, tmp_path):
    from anchorage.sources import readers

    (tmp_path / "a.csv").write_text("p,q\n1,2\n")
    (tmp_path / "b.csv").write_text("q,p\n2,1\n")
    with pytest.raises(Exception, match="header"):
        readers.read_delimited(spark, str(tmp_path)).collect()


def test_years_of_two_digits(spark):
    from datetime import date

    from anchorage.functions import columns

    texts = ["31/12/98", "1-2-05", "98/12/31", "31/12/1998", "32/13/99"]
    got = [r.d for r in spark.createDataFrame([(x,) for x in texts], "x string").select(columns.parse_date_any(F.col("x")).alias("d")).collect()]
    assert got == [date(1998, 12, 31), date(2005, 2, 1), date(1998, 12, 31), date(1998, 12, 31), None]


def test_risk_joins_either_spelling_of_the_id(spark):
    from anchorage.operators import integrate

    risk = {n: None for n in integrate.RISK_COLUMNS} | {"risk_12m": "0.25", "grupo_operativo": " alto "}
    perm = spark.createDataFrame([("7", *risk.values())], "AFILIADO_ID_EPS string, " + ", ".join(f"{n} string" for n in risk))
    got = integrate.with_risk(spark.createDataFrame([(7,), (8,)], "Afiliado_id_eps long"), perm)
    assert "AFILIADO_ID_EPS" in got.columns
    assert {r.AFILIADO_ID_EPS: (r.risk_12m, r.grupo_operativo) for r in got.collect()} == {"7": (0.25, "ALTO"), "8": (None, None)}


def test_dates_with_month_names(spark):
    texts = ["12 January 2020", "3 de enero de 2019", "03-ENE-2019", "2021 March 7", "7/sept/2021", "31 febrero 2020", "may", "1, Dec, 99", "12 foo 2020"]
    assert values(spark, c.parse_date_any, texts) == [
        dt.date(2020, 1, 12),
        dt.date(2019, 1, 3),
        dt.date(2019, 1, 3),
        dt.date(2021, 3, 7),
        None,
        None,
        None,
        dt.date(1999, 12, 1),
        None,
    ]
