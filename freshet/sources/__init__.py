"""Scans: daily reading files, JSON catalogues, polygons, area files, SQL."""
