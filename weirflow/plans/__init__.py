"""Named queries over the test tables and the SQL that states what each must return."""
