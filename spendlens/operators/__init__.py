"""DataFrame to DataFrame operators on a (geo, week) panel."""
