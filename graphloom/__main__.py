from graphloom.cli import main

main()
