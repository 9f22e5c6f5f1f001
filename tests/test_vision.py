import json
from dataclasses import replace
from datetime import datetime

from quillon.models.offline import Models
from quillon.operators.vision import describe, enrich
from quillon.operators.windows import select_for_vision

ITEMS = "id string, source string, ts timestamp, sender string, text string, media_path string, is_system boolean, meta string, source_group string, seq long"


def test_enrich(spark):
    rows = [(f"i{k}", "photo", datetime(2024, k, 1), None, None, f"{k}.jpg", False, '{"lat":1.5,"taken_source":"exif"}', "photos", k) for k in (1, 2, 3)]
    items = spark.createDataFrame(rows, ITEMS)
    files = spark.createDataFrame([(f"{k}.jpg", bytes([k])) for k in (1, 2, 3)], "path string, content binary")

    def tagger(c):
        return {"people": 0.2 * c[0], "receipt": 0.9 if c[0] == 3 else 0.0, "pet": 0.1}

    def faces(c):
        return [{"bbox": [0.0, 0.0, 1.0, 1.0], "embedding": [1.0, 0.01 * c[0]]}] if c[0] < 3 else [{"bbox": [0.0] * 4, "embedding": [-1.0, 0.0]}]

    def photo(c):
        if c[0] == 2:
            raise RuntimeError("down")
        return {"scene": "park", "activity": None, "people_count": 1, "notable": []}

    models = replace(Models(), tagger=tagger, ocr=lambda c: [f"line {c[0]}"], faces=faces, photo_model=photo)
    meta = {r.id: json.loads(r.meta) for r in enrich(items, files, models, cap=5).collect()}
    assert meta["i1"]["face_labels"] == meta["i2"]["face_labels"] == ["face:0"] and "face_labels" not in meta["i3"]
    assert meta["i1"]["ocr_lines"] == ["line 1"] and meta["i1"]["vision_tags"] == ["people", "pet", "receipt"] and meta["i1"]["lat"] == 1.5
    assert json.loads(meta["i1"]["photo_facts"])["scene"] == "park" and "down" in meta["i2"]["vision_llm_error"] and "photo_facts" not in meta["i3"]


def test_selection_and_failures(spark):
    rows = [(1, {"people": 0.9}, "2024-01-02"), (2, {"people": 0.8}, "2024-01-03"), (3, {"people": 0.1}, "2024-02-01"), (4, {"document": 0.9, "people": 0.8}, "2024-02-01"), (5, {"event": 0.5}, None)]
    df = spark.createDataFrame(rows, "seq long, tags map<string,float>, taken string")
    assert [r.seq for r in select_for_vision(df, 4).collect()] == [5, 1, 3, 2]
    assert [r.seq for r in select_for_vision(df, 2, with_dates=False).collect()] == [1, 2]
    assert describe(spark.createDataFrame([], "path string, content binary"), Models()).count() == 0
