"""Plans over the library's operators: registered queries, questions in words, and named tools."""
