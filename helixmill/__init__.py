"""helixmill: sequence analytics and corpus preparation as Spark jobs."""
