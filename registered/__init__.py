"""The queries the driver runs and the SQL it compares them with."""
