"""Fetchers that tests inject; what they serve lies in a file, as workers are other processes."""

from __future__ import annotations

import json
import os

STATE = os.environ.get("FAKE_CATALOGUE", "/tmp/groundlake-fake-catalogue.json")


def page(first, size, sort):
    held = json.load(open(sort if sort.startswith("/") else STATE))
    return {"total": len(held), "records": held[first : first + min(size, 3)]}  # at most three at a time
