"""DataFrame -> DataFrame operators. None of them triggers an action except
where a bounded scalar is needed (noted in the docstring)."""
