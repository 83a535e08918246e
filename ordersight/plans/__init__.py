"""Composed jobs: cleaning DAG, feature build, training, scoring, query catalogue."""
