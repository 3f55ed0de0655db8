"""How queries meet the cluster: shipping of code, sizes of partitions."""
