"""playgraph.sources"""
