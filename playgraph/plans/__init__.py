"""playgraph.plans"""
