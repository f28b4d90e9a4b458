"""Every query of the engine over the sample tables, and the SQL that checks it."""
