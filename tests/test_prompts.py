"""What a model is told, case by case."""

from pyspark.sql import functions as F

from lumbrera.operators import prompts


def test_topic_blocks(spark):
    topics = [("m", "b", "Bee", None, "", [], 2), ("m", "a", "Ay", "what", "when", ["x", "y"], 2), ("m", "z", None, "", None, None, 1)]
    df = spark.createDataFrame(topics, "matrix string, code string, name string, description string, criterion string, keywords array<string>, position int")
    got = {r["matrix"]: r["block"] for r in prompts.topic_blocks(spark.createDataFrame([("m",), ("none",)], "matrix string"), df).collect()}
    assert got["none"] == "(sin temas activos en la matriz)"
    assert got["m"] == "  - z | \n  - a | Ay\n    Descripción: what\n    Criterio de relevancia: when\n    Palabras clave (señales auxiliares): x, y\n  - b | Bee"


def test_sections(spark):
    rows = [("T", "text", "ex", "{}"), ("T", "", "ex", "{}"), ("T", None, "", "{}"), (None, None, None, None), ("", " ", "ex", None), ("T", "x" * 11, "ex", None), ("T", "x" * 10, None, None)]
    df = spark.createDataFrame(rows, "title string, content string, excerpt string, meta string")
    got = [tuple(r[0]) for r in df.select(prompts.document_section(F.col("title"), F.col("content"), F.col("excerpt"), F.col("meta"), 10)).collect()]
    brief = "[AVISO: Contenido completo no disponible. Se proporciona extracto.]\nExtracto: ex"
    none = "[AVISO: Contenido completo y extracto no disponibles.]\nTítulo: {}\nMetadatos disponibles:\n{}"
    want = [("T", "Contenido completo:\ntext"), ("T", brief), ("T", none.format("T", "{}")), ("(sin título)", none.format("", "(ninguno)")), ("(sin título)", "Contenido completo:\n "), ("T", None), ("T", "Contenido completo:\n" + "x" * 10)]
    assert got == [(t, s, None if s is None else len(s), "input_too_large" if s is None else None) for t, s in want]
