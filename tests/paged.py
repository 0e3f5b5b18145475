"""What stands for a service in the test of the paged source."""


def ask(request: dict) -> dict:
    part, go_on = request["part"], request.get("from", 0)
    out = {"query": {"pages": [{"pageid": 10 * part + go_on, "title": "t", "revisions": []}]}}
    return out | ({"continue": {"from": 1}} if not go_on else {})
