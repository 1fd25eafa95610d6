"""SQL that states the expected result of each registered query."""
