"""operators of the select-project-join engine."""
