"""All registered queries: name -> (Spark query, comparison SQL or None)."""

from __future__ import annotations

from hushline.plans import catalog_detect, catalog_playback, catalog_streams, catalog_tracks

CASES = {**catalog_detect.CASES, **catalog_playback.CASES, **catalog_tracks.CASES, **catalog_streams.CASES}
