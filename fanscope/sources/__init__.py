"""Input readers: raw TSV tables, topic JSON files and the test-fixture adapter."""
