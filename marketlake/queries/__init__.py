"""The registered queries by family, each with the SQL that checks it where SQL can express it."""
