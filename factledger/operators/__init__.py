"""General relational operators the jobs are composed of."""
