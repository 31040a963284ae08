"""What is settled on the driver before a query runs: schema annotations, names and namespaces, encoding expressions."""
