"""Reading texts and keeping indexes."""
