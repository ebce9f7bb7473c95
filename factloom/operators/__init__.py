"""factloom.operators"""
