"""Response JSON: any invalid action rejects the whole response (zero actions + apology)."""

from steerclust.operators import feedback as FB


def test_whole_response_rejection(spark):
    good = '{"thought_process": "t", "actions": [{"feedback_type": "must_link", "item_ids": [1, 2]}, {"feedback_type": "miscluster", "item_ids": [3], "confidence": 0.5}], "reply_to_user": "ok"}'
    bad_type = '{"thought_process": "t", "actions": [{"feedback_type": "must_link", "item_ids": [1, 2]}, {"feedback_type": "bogus"}], "reply_to_user": "ok"}'
    bad_conf = '{"thought_process": "t", "actions": [{"feedback_type": "must_link", "item_ids": [1, 2], "confidence": 1.5}], "reply_to_user": "ok"}'
    broken = '{"thought_process": "t", "actions": []'
    missing_reply = '{"thought_process": "t", "actions": []}'
    rows = [(i, r) for i, r in enumerate([good, bad_type, bad_conf, broken, missing_reply])]
    df = spark.createDataFrame(rows, "rid long, response string")
    out = {r["rid"]: r for r in FB.parse_action_json(df).collect()}
    assert out[0]["accepted"] and len(out[0]["actions"]) == 2
    assert out[0]["actions"][0]["confidence"] == 1.0  # default
    for rid in (1, 2, 3, 4):
        assert not out[rid]["accepted"] and len(out[rid]["actions"]) == 0
        assert out[rid]["reply"] == FB.APOLOGY
    acts = FB.explode_actions(FB.parse_action_json(df), ["rid"])
    v = {(r["rid"], r["action_pos"]): r["valid"] for r in FB.validate_actions(acts).collect()}
    assert v == {(0, 0): True, (0, 1): True}
