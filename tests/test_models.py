import json

import pytest

from tarnwell.operators import models
from tarnwell.plans import analyze, catalog
from tests.transcripts import write


def test_schemas_lose_references():
    schema = {"type": "object", "properties": {"x": {"$ref": "#/$defs/X"}, "n": {"type": "number", "minimum": 0}}, "$defs": {"X": {"type": "array", "minItems": 1, "items": {"type": "string", "pattern": "a"}}}}
    assert models.plain_schema(schema) == {"type": "object", "additionalProperties": False, "properties": {"x": {"type": "array", "items": {"type": "string"}}, "n": {"type": "number"}}}


def test_replies():
    want = {"a": 1}
    for reply in ({"output": want}, {"output": json.dumps(want)}, {"content": [{"type": "output", "json": want}]}, {"content": [{"type": "thinking"}, {"type": "text", "text": '```json\n{"a": 1}\n```'}]}):
        assert models.answer_of(reply) == want
    with pytest.raises(models.Refused):
        models.answer_of({"stop_reason": "refusal", "output": want})
    with pytest.raises(ValueError):
        models.answer_of({"content": [{"type": "text", "text": "no"}]})


def test_session_models(spark, tmp_path):
    corpus = catalog.Corpus(spark, str(write(tmp_path / "c")), tables=str(tmp_path / "tables"))

    def classify(text):
        if "again" in text:
            raise RuntimeError("busy")
        if "compact" in text:
            return {"autonomy_tier": "assisted", "success": "odd", "confidence": "0.5"}
        raise models.Refused("no")

    def conflicts(text):
        return {"conflicts": [{"turn_a_uuid": "u1", "turn_b_uuid": "a1", "conflict_kind": "reversal", "confidence": 0.7}, {"turn_a_uuid": "u1", "turn_b_uuid": "u1"}, {"turn_a_uuid": "u1", "turn_b_uuid": "nowhere"}]}

    def arcs(prompt):
        return []

    skip = tuple(s for s in analyze.STAGES if s not in ("classify", "conflicts", "trajectory"))
    run = lambda: analyze.run_analyze(corpus, days=None, dry_run=False, skip=skip, session_models={"classify": classify, "conflicts": conflicts}, trajectory_model=arcs)
    assert analyze.run_analyze(corpus, days=None, skip=skip)["classify"] == {"pending": 3, "calls": 3, "tokens_in": 8000, "tokens_out": 300, "usd": 0.0855}
    done = run()
    assert done["classify"] == {"sessions": 2, "rows": 1} and done["conflicts"] == {"sessions": 3, "rows": 1}
    row = corpus.analytics["session_classifications"].first()
    assert (row["session_id"], row["autonomy"], row["success"], row["confidence"]) == ("s1", "assisted", None, 0.5)
    assert corpus.analytics["conflicts_summary"].first()["conflict_count"] == 1
    assert corpus.analytics["message_trajectory"].where("confidence = 0").count() == corpus.views["turn_window"].count()
    again = run()
    assert again["classify"] == {"sessions": 0, "rows": 0} and again["trajectory"]["sessions"] == 0
    from tarnwell.sources import store

    queue = store.read(spark, tmp_path / "tables" / "retry_queue").collect()
    assert [(r["unit_id"], r["attempts"], r["error"]) for r in queue] == [("s2", 2, "busy")]
